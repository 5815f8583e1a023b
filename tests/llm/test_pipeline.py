"""The pipeline's five stages, each against a plain version of it on a small table; the verdict of the quality rules."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_brute_force import LOWER, TERM, WORD, groups_of

import corpus_pipeline
from fieldweave.llm import columnar, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __k string, hits int, cut boolean"


def make_rows():
    rng = random.Random(12)
    good = [f"soil{i}" for i in range(400)]
    bad = [f"buy{i}" for i in range(400)]
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    shared = say([f"notice{i}" for i in range(90)], 60)
    bench = " ".join(f"question{i}" for i in range(40))
    rows = []
    for i in range(60):
        rows.append((i, say(good, rng.randrange(70, 160)), "en", rng.choice(["a", "b", None])))
    for i in range(60, 90):
        rows.append((i, say(bad, rng.randrange(70, 160)), None, "c"))
    base = rows[3][1].split(" ")
    base[20] = "edited"
    rows += [(100, " ".join(base), "en", "a"), (101, rows[3][1], "en", "a"), (101, rows[4][1] + " tail", "de", "b"), (101, rows[4][1] + " tail", "de", "b")]
    rows += [(110 + i, say(good, 40) + " " + shared + " é " + say(good, 60), "en", "a") for i in range(4)]
    rows += [(120, say(good, 300) + " " + " ".join(bench.split(" ")[5:19]) + " " + say(good, 100), "en", "b"), (121, say(good, 60) + " " + bench, "en", "b")]
    rows += [(None, say(good, 90), "en", "a"), (None, say(good, 90), "en", None), (None, None, None, None), (130, "", "en", "a"), (131, " \n", "en", "a"), (132, "three short words", "en", "a"), (133, "the same " * 80, "en", "b"), (134, say(good, 12000), "en", "b")]
    return [(k, t, lang, source, len(t or ""), "x", 3, True) for k, t, lang, source in rows], [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(60, 70)] + [(70, 1, 1), (None, 1, 0)], [(1, bench), (2, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels, bench = make_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def grams(text):
    """Buckets of the unigrams and bigrams of one text."""
    words = [w.encode() for w in WORD.findall(text or "")]
    if not words:
        return []
    one = [int(columnar.RollingHash.of_bytes(np.frombuffer(w, np.uint8)).spans(np.array([0]), np.array([len(w)]))[0]) for w in words]
    two = [int(columnar.RollingHash(np.array(p, dtype=np.uint64)).spans(np.array([0]), np.array([2]))[0]) for p in zip(one, one[1:])]
    return [h % quality.BUCKETS for h in one + two]


def plain_quality(rows, labels, held):
    """(score, kept) of each row; held: held-out flag of each trusted key."""
    counts = [collections.Counter(), collections.Counter()]
    for r in rows:
        counts[0].update(grams(r[1]))
        if held.get(r[0]) is False:
            counts[1].update(grams(r[1]))
    total = [sum(c.values()) + 0.5 * quality.BUCKETS for c in counts]
    ratio = lambda b: math.log((counts[1][b] + 0.5) / total[1]) - math.log((counts[0][b] + 0.5) / total[0])
    scores = [sum(map(ratio, grams(r[1]))) / max(len(grams(r[1])), 1) for r in rows]
    cells = sorted(int((s + 8) / 16 * 8192) for s, r in zip(scores, rows) if held.get(r[0]))
    edge = max(e for e in range(8193) if sum(c < e for c in cells) <= 0.005 * len(cells))
    out = []
    for r, s in zip(rows, scores):
        w = WORD.findall(r[1] or "")
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        again = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in range(3)}
        out.append((s, len(w) >= 50 and 100 * len(again) <= 50 * len(w) and s >= -8 + 16 * edge / 8192))
    return out


def trusted(spark, labels):
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {r["doc_id"]: r["held_out"] for r in quality._trusted(df, "doc_id").collect()}


def test_verdict_of_the_quality_rules(spark, tables):
    rows, labels, _ = make_rows()
    want = plain_quality(rows, labels, trusted(spark, labels))
    got = quality.quality(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9), r["kept"]) for r in got) == sorted((str(r[0]), round(s, 9), k) for r, (s, k) in zip(rows, want))
    kept = {r[0] for r, (_, k) in zip(rows, want) if k}
    assert not kept & set(range(60, 90)) and len(kept & set(range(60))) >= 58


def test_all_trusted_rows_count(spark, tables, monkeypatch):
    many = spark.range(200_050).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality._trusted(many, "doc_id").count() == 200_050
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    whole = bag(quality.quality(docs, labels).collect())
    monkeypatch.setattr(quality, "TRUSTED_BLOCK", 7)
    assert len(quality._blocks(docs, labels, "doc_id")) == 11
    assert bag(quality.quality(docs, labels).collect()) == whole


def plain_first(rows):
    # Documents without a key are told apart here by their place.
    label, key = groups_of([(-(2**62) + i if r[0] is None else r[0], *r[1:]) for i, r in enumerate(rows)], shingle=5)
    by = collections.defaultdict(list)
    for i, (n, c) in enumerate(label):
        by[(c if n else ("none", key[i], rows[i][1] if rows[i][0] is not None else i))].append(i)
    out = []
    for members in by.values():
        low = min(key[i] for i in members)
        out.append([rows[i] for i in members if key[i] == low])
    return out


def plain_repeats(rows, width=200):
    raws = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + width] for t in raws for i in range(len(t) - width + 1))
    out = []
    for r, t in zip(rows, raws):
        mark = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                mark[i : i + width] = b"\1" * width
        text = bytes(b for b, m in zip(t, mark) if not m).decode("utf-8", "ignore") if any(mark) else r[1]
        out.append((r[0], text, *r[2:4], len(text) if any(mark) else r[4], *r[5:]))
    return out


def plain_clean(rows, bench):
    words = lambda t: TERM.findall((t or "").translate(LOWER))
    windows = {tuple(w[i : i + min(13, len(w))]) for _, t in bench for w in [words(t)] if w for i in range(len(w) - min(13, len(w)) + 1)}
    out = []
    for r in rows:
        at = [m.span() for m in TERM.finditer(r[1] or "")]
        w = words(r[1])
        hit = sorted({i + j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(n)})
        if hit and 20 * len(hit) >= len(w):
            continue
        text = r[1]
        for i in reversed([i for i in hit if i - 1 not in hit]):
            j = next(j for j in range(i, len(w)) if j + 1 not in hit)
            text = text[: at[i][0]] + text[at[j][1] :]
        out.append((r[0], text, *r[2:4], len(text) if hit else r[4], *r[5:]))
    return out


def test_stages(spark, tables, tmp_path):
    from tokenizers import Tokenizer

    from fieldweave.llm import tokens

    rows, labels, bench = make_rows()
    docs, before, outs = spark.read.parquet(f"{tables}/documents.parquet"), rows, []
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "minhash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        got = docs.collect()
        if i == 0:
            want = [r for r, (_, k) in zip(before, plain_quality(before, labels, trusted(spark, labels))) if k]
            assert bag(got) == bag(want) and 120 in {r[0] for r in want}
        elif i == 1:
            groups = plain_first(before)
            left = bag(got)
            assert len(got) == len(groups) and all(sum(left[tuple(r)] > 0 for r in {tuple(x) for x in g}) == 1 for g in groups)
        elif i == 2:
            assert bag(got) == bag(plain_repeats(before)) and any("notice" not in r[1] for r in got if r[0] in (110, 111))
        elif i == 3:
            assert bag(got) == bag(plain_clean(before, bench))
            assert 121 not in {r[0] for r in got} and "question" not in next(r[1] for r in got if r[0] == 120)
        else:
            t = Tokenizer.from_file(tokens.tokenizer_path())
            ids = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in before]
            assert sum(r["length"] for r in got) == sum(map(len, ids))
            crcs = {(r[0], zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes())) for r, x in zip(before, ids) for p in got if p["doc_id"] == r[0]}
            assert all((p["doc_id"], p["ids_crc32"]) in crcs for p in got)
            used = collections.Counter()
            for p in got:
                used[p["sequence_id"]] += p["length"]
            assert sorted(used) == list(range(len(used))) and all(n == 2048 for s, n in used.items() if s < len(used) - 1)
        outs.append(len(got))
        before = [tuple(r) for r in got]
    assert corpus_pipeline.run(spark, tables).count() == outs[-1]


def test_empty_tables(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_against_sql(spark):
    """The registered queries with SQL, on the smallest tables."""
    import os

    import duckdb

    from fieldweave.llm import queries

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns), name
        assert bag([str(r[n]) for n in names] for r in df.collect()) == bag([str(v) for v in r] for r in result.fetchall()), name
