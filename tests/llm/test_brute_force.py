"""The operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import archives, columnar, decontaminate, kd_shards, licenses, near_dedup, packing, quality, storage, suffix_dedup, token_files, tokens, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, hits string, __note string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def texts() -> list:
    rng = random.Random(4)
    words = ["der", "Soil", "é", "naïve", "x1", "Über", "日本", "don't", "a_b", "12", "#", "—"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = say(120)
    near = base.split(" ")
    near[60] = "edited"
    out = [None, "", " \n\t", base, base, " ".join(near), base[:300] + say(30), say(80) + base[100:400] + say(10), "ab" * 400, "one two", "one  two", "One two\n", "x"]
    out += ["Licensed under the GNU General Public License, version 3. All rights reserved.", "CC BY-NC 4.0 cc by", "the the the " * 30, say(60) + "\n" + say(5) + "\n" + say(60)]
    out += [say(rng.randrange(1, 90)) for _ in range(20)]
    line = "\nsame line here\n"
    return out + [say(52) + line + line]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, ["de", "en", None][i % 3], [None, "a", "b"][i % 3], len(t or ""), 7, "h", "n") for i, t in enumerate(texts())]
    return [*made, made[5], (None, "no key at all", "en", "a", 3, 7, "h", "n")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bag(df, key="doc_id"):
    return sorted((str(r[key]), tuple(v for k, v in sorted(r.asDict().items()) if k != key)) for r in df.collect())


def test_words_match_patterns():
    import pyarrow as pa

    column = pa.array(texts())
    data, offsets = columnar.text_buffer(column)
    for table, pattern in ((columnar.VISIBLE, WORD), (columnar.ALNUM, TERM)):
        w = columnar.Words(data, offsets, table)
        got = [data[a:b].tobytes().decode().translate(LOWER) for a, b in zip(w.starts, w.ends)]
        assert got == [x for t in texts() for x in pattern.findall((t or "").translate(LOWER))]


@pytest.mark.parametrize("hot, gather", [(4096, 1 << 17), (1, 40)])
def test_suffix_dedup(spark, docs, rows, none, monkeypatch, hot, gather):
    monkeypatch.setattr(suffix_dedup, "GATHER", gather)
    rng = random.Random(11)
    common = "".join(rng.choice("abcdef ") for _ in range(58))
    more = [(200 + i, "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + common + "".join(rng.choice("uv") for _ in range(rng.randrange(40))), "en", "a", 1, 7, "h", "n") for i in range(60)]
    rows = [*rows, *more, rows[3], rows[3], (None, rows[3][1], "en", "a", 3, 7, "h", "n")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    width, seen = 60, collections.Counter()
    raws = [(r[1] or "").encode() for r in rows]
    for t in raws:
        seen.update(t[i : i + width] for i in range(len(t) - width + 1))
    want, cuts = [], []
    for r, t in zip(rows, raws):
        m = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                m[i : i + width] = b"\1" * width
        kept = bytes(b for b, x in zip(t, m) if not x)
        want.append((str(r[0]), (hashlib.sha256(kept).hexdigest(), len(t), sum(m), len(re.findall(b"\1+", bytes(m))))))
        cuts.append(kept.decode("utf-8", "ignore") if any(m) else None)
    got = suffix_dedup.digests(docs, width=width, grams=(16, 40), hot=hot, block_bytes=4096)
    assert as_bag(got) == sorted(want)
    assert suffix_dedup.digests(none).count() == 0
    cut = suffix_dedup.remove_repeats(docs.withColumnsRenamed({'k': '__k', 'hits': '__marked', 'lang': 'c'}), width=width, grams=(16, 40)).withColumnsRenamed({'__k': 'k', '__marked': 'hits', 'c': 'lang'})
    assert cut.columns == docs.columns and cut.count() == len(rows)
    sizes = {str(r["doc_id"]): r["text"] for r in cut.collect()}
    assert sizes["0"] is None and sizes["3"] == "" and sizes["9"] == "one two"
    left = collections.Counter((str(r["doc_id"]), r["text"], r["n_chars"]) for r in cut.collect())
    assert left == collections.Counter((str(r[0]), r[1] if kept is None else kept, r[4] if kept is None else len(kept)) for r, kept in zip(rows, cuts))


def test_hot_fragments_are_cut_without_a_shuffle_of_texts(spark, docs, rows, monkeypatch):
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA).repartition(3)
    options = {"width": 60, "grams": (16, 40), "block_bytes": 4096}
    whole = as_bag(suffix_dedup.digests(docs, **options))
    plans, write = [], suffix_dedup.written

    def noted(df, name):
        if name == "hot-fragments":
            plans.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(suffix_dedup, "written", noted)
    monkeypatch.setattr(suffix_dedup, "CUT_BLOCK", 10, raising=False)
    assert as_bag(suffix_dedup.digests(docs, hot=1, **options)) == whole
    assert not any("ShuffledHashJoin" in p or "SortMergeJoin" in p for p in plans)
    assert len(plans) > 2


def test_run_index_compresses_repeats():
    from fieldweave.llm.run_index import RunIndex

    rng = random.Random(1)
    base = bytes(rng.randrange(97, 105) for _ in range(3000))
    pieces = [base[i : i + 700] for i in range(0, 2400, 300)]
    for i in range(40):
        piece = bytearray(base[:700])
        piece[rng.randrange(700)] = 33
        pieces.append(bytes(piece))
    twice = np.array([i % 3 == 0 for i in range(len(pieces))])
    index = RunIndex(pieces, 200, twice)
    assert index.rows == sum((len(p) + 1) * (1 + t) for p, t in zip(pieces, twice))
    assert 4 * len(index.heads) < index.rows
    seen = collections.Counter()
    for p, t in zip(pieces, twice):
        for i in range(len(p) - 199):
            seen[p[i : i + 200]] += 1 + bool(t)
    long = index.long_matches()
    for b, p in zip(index.begin, pieces):
        assert [bool(long[b + i]) for i in range(len(p) - 199)] == [seen[p[i : i + 200]] > 1 for i in range(len(p) - 199)]


def test_run_index_steps_without_search(monkeypatch):
    from fieldweave.llm.run_index import RunIndex

    rng = random.Random(2)
    pieces = [bytes(rng.randrange(97, 100) for _ in range(500)) for _ in range(30)]
    index = RunIndex(pieces, 12)
    searched, search = [], np.searchsorted

    def noted(a, v, *args, **kwargs):
        searched.append(np.size(v))
        return search(a, v, *args, **kwargs)

    monkeypatch.setattr(np, "searchsorted", noted)
    long = index.long_matches()
    assert sum(searched) <= 500  # steps, not letters (15,000)
    seen = collections.Counter(p[i : i + 12] for p in pieces for i in range(len(p) - 11))
    for b, p in zip(index.begin, pieces):
        assert [bool(long[b + i]) for i in range(len(p) - 11)] == [seen[p[i : i + 12]] > 1 for i in range(len(p) - 11)]


def test_suffix_order_and_prefixes():
    from fieldweave.llm.run_index import common_prefix, packed, suffix_array

    rng = random.Random(3)
    for letters, size in ((1, 60), (2, 300), (257, 300)):
        text = [rng.randrange(257 - letters, 257) for _ in range(size // 2)]
        text += [0, *text[: size // 3], 0]
        keys = packed(np.array(text, dtype=np.int16))
        assert suffix_array(keys).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        a, b = (np.array(x) for x in zip(*[(i, j) for i in range(-1, len(text), 3) for j in range(len(text)) if i != j]))
        for most in (1, 7, 20):
            want = [0 if i < 0 else next((k for k in range(most) if text[i + k : i + k + 1] != text[j + k : j + k + 1]), most) for i, j in zip(a, b)]
            assert common_prefix(keys, a, b, most).tolist() == want


@pytest.mark.parametrize("width", [1, 2, 7, 8, 153])
def test_sliding_minimum(width):
    x = np.random.default_rng(4).integers(0, 1 << 63, 400, dtype=np.uint64)
    for size in (0, width - 1, width, 400):
        assert suffix_dedup.sliding_minimum(x[:size], width).tolist() == [min(x[i : i + width].tolist()) for i in range(size - width + 1)]


def test_quality_base(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 34)] + [(20, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {str(r["doc_id"]): r for r in quality.quality(docs, labels).collect()}
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
        g = got[str(r[0])]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == want
        assert g["kept"] <= (not g["base_failed"])
    assert quality.quality(none, labels).count() == 0
    unlabelled = quality.quality(docs, labels.where("false"))
    assert unlabelled.where("kept = base_failed").count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_log_ratio():
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    raw[:2], target[:2] = (30, 10), (3, 1)
    r = quality.log_ratio(raw, target)
    p = [(x[1] + 0.5) / (x.sum() + 0.5 * quality.BUCKETS) for x in (target, raw)]
    assert abs(r[1] - np.log(p[0] / p[1])) < 1e-9
    assert not quality.log_ratio(raw, np.zeros(quality.BUCKETS)).any()


def test_kd_shards(docs, rows, none):
    got = kd_shards.kd_shards(docs, shards=5).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    text = {str(r[0]): (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(text[str(r["doc_id"])]) + 16 and r["text_crc32"] == zlib.crc32(text[str(r["doc_id"])]) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(5)) and all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(x["size"] for x in by[s]) - total / 5) <= 2 * largest for s in range(5))
    assert kd_shards.kd_shards(none, shards=4).count() == 0
    assert kd_shards.kd_shards(docs, target_bytes=10**9).where("shard > 0").count() == 0


def kd_brute(points, shards, first=0):
    """Plain k-d tree over (size, coordinates): shard of each point."""
    if shards == 1 or not points:
        return {i: first for i, _, _ in points}
    spread = [max(c[d] >> 31 for _, _, c in points) - min(c[d] >> 31 for _, _, c in points) for d in range(len(points[0][2]))]
    d = max(range(len(spread)), key=lambda d: (spread[d], -d))
    points = sorted(points, key=lambda p: p[2][d])
    target, done, at = sum(s for _, s, _ in points) * (shards // 2) / shards, 0, 0
    while done + points[at][1] < target:
        done += points[at][1]
        at += 1
    at += not (target - done < points[at][1] / 2)
    return kd_brute(points[:at], shards // 2, first) | kd_brute(points[at:], shards - shards // 2, first + shards // 2)


def test_kd_tree_against_plain_splits(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "t" * rng.randrange(1, 400), rng.choice(["de", "en", "en", None]), f"common-source-{rng.randrange(9)}", rng.randrange(1, 10**6)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen, real = [], kd_shards._grow
    monkeypatch.setattr(kd_shards, "_grow", lambda points, *rest: seen.append(points) or real(points, *rest))
    monkeypatch.setattr(kd_shards, "BINS", 64)
    for shards in (2, 11):
        got = {r["doc_id"]: r["shard"] for r in kd_shards.kd_shards(df, shards=shards, tolerance=0).collect()}
        points = [(r["key"], r["size"], [r[f"c{d}"] for d in range(3)]) for r in seen[-1].collect()]
        order = [sorted(points, key=lambda p: p[2][d]) for d in range(3)]
        assert [rows[p[0]][3] for p in order[1]] == sorted(r[3] for r in rows)
        assert [rows[p[0]][2] or "" for p in order[0]] == sorted(r[2] or "" for r in rows) and [rows[p[0]][4] for p in order[2]] == sorted(r[4] for r in rows)
        assert got == kd_brute(points, shards)


def test_kd_sees_whole_strings_and_splits_equal_rows(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'x' as text", "concat('common-source-', id % 4) as source")
    got = kd_shards.kd_shards(df, shards=4, dims=("source",)).join(df, "doc_id")
    assert got.groupBy("source").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    same = spark.range(1000).selectExpr("cast(null as long) as doc_id", "'x' as text", "'a' as source", "cast(1 as long) as n_chars", "current_date() as lang")
    counts = [r["count"] for r in kd_shards.kd_shards(same, shards=8).groupBy("shard").count().collect()]
    assert sorted(counts) == [125] * 8
    many = kd_shards.kd_shards(df, target_bytes=2048)
    assert many.groupBy("shard").count().agg(F.max("count"), F.count("*")).first()[0] <= 125


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_encoder(tokenizer):
    import pyarrow as pa

    odd = ["It's ’tis don't", "H̱ É É İ ΑΣ", "a×b÷c 12.5% x²", "<|startoftext|>x", "the\x00null\x1cfs\x85nel", "ﬁ ŉ ſ", "¿Qué? «oui»…", "x" * 3000, *texts()]
    e = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(2):
        ids, at = e.encode(*columnar.text_buffer(pa.array(odd)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_encoder_on_random_strings(tokenizer):
    import pyarrow as pa

    rng = random.Random(8)
    signs = [" ", "\n", "\xa0", "'", ".", "(", ")", "-", "1", "5", "a", "B", "\u0301", "\u0130", "<|endoftext|>", "'s", "日", "\u212b", "\u00ad"]
    letters = [chr(c) for c in range(0x80, 0x250)]
    said = [f(c) for c in letters for f in (lambda c: c + ".", lambda c: f"({c})", lambda c: f"5{c}7", lambda c: f"a{c}B {c}", lambda c: f"{c}.\u00d6. 5")]
    said += ["".join(rng.choice(signs if rng.random() < 0.5 else letters) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    e = tokens.Encoder(tokens.tokenizer_path())
    for at in range(0, len(said), 1500):
        part = said[at : at + 1500]
        ids, ends = e.encode(*columnar.text_buffer(pa.array(part)))
        got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        bad = [(t, g) for t, g in zip(part, got) if g != tokenizer.encode(t, add_special_tokens=False).ids]
        assert not bad, bad[:5]


def test_encoder_forgets_and_spells(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHE_PARTS", 60)
    e = tokens.Encoder(tokens.tokenizer_path())
    for i in range(40):
        said = [f"common words here stay w{j} x{'q' * (j % 7)} 7{j}" for j in range(i, i + 12)]
        ids, ends = e.encode(*columnar.text_buffer(pa.array(said)))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in said]
    assert 0 < e.count < 200
    spelt = tokens.Encoder(tokens.tokenizer_path(), specials=False).encode(*columnar.text_buffer(pa.array(["a <|endoftext|> b"])))[0]
    assert spelt.tolist() == [320, 27, 347, 40786, 4160, 91, 285, 321]


def test_token_files(docs, rows, none, tokenizer):
    ids = sorted([(-(2**63) if r[0] is None else r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows], key=lambda x: x[0])
    starts = np.cumsum([0, *[len(x) for _, x in ids]])
    want = sorted((str(None if k == -(2**63) else k), int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (k, x), s in zip(ids, starts))
    got = sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(docs).collect())
    assert got == want
    assert token_files.digests(none).count() == 0


def test_variable_length_round_trip():
    x = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 5 + [3], dtype=np.uint32)
    control, data = token_files.pack(x)
    assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(x)) == x).all()


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_packing(docs, rows, none, tokenizer, block):
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    got = packing.pack(docs, width=64, block_tokens=block).collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[str(r["doc_id"])].append(r)
    for key, want in {str(r[0]): x for r, x in zip(rows, ids)}.items():
        times = sum(str(r[0]) == key for r in rows)
        spans = sorted((r["start"], r["length"]) for r in pieces[key])
        assert sum(n for _, n in spans) == times * len(want) and all(r["doc_tokens"] == len(want) for r in pieces[key])
        for r in pieces[key]:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    rooms = collections.defaultdict(list)
    for r in got:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in rooms.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(rooms) == list(range(len(rooms)))
    assert packing.pack(none).count() == 0


def test_deficits_hold_the_mixture():
    lengths = [np.full(400, 50), np.full(100, 100), np.full(20, 500)]
    shares = np.array([20000, 10000, 10000]) / 40000
    used = np.zeros(3)
    for w, _, q, _, _, n in packing.fill(lengths, shares, np.zeros(3), 1000, 100):
        used[q] += n
        assert (np.abs(used - shares * 1000 * (w + 1)) <= 1200).all()


def test_mixture_unlike_the_corpus(spark, tokenizer):
    rng = random.Random(6)
    word = ["soil", "tree", "water", "plot", "leaf"]
    rows = [(i, " ".join(rng.choice(word) for _ in range(rng.randrange(5, 60))), "a" if rng.random() < 0.85 else "b" if rng.random() < 0.9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for mixture in ({"a": 1, "b": 1}, {"b": 3, "a": 1}, {None: 1, "b": 1}):
        got = packing.pack(df, mixture=mixture, width=512, block_tokens=8192).collect()
        assert sum(r["length"] for r in got) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows)
        size = collections.Counter()
        for _, t, s in rows:
            size[s] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        used, parts = collections.Counter(), sorted((r["sequence_id"], r["offset"], r["source"], r["length"]) for r in got)
        until = min(size[s] / (x / sum(mixture.values())) for s, x in mixture.items())  # tokens out when the first source is used up
        worst = {}
        for n, (_, group) in enumerate(itertools.groupby(parts, key=lambda p: p[0]), 1):
            for _, _, s, length in group:
                used[s] += length
            if sum(used.values()) < 0.85 * until:
                for s, x in mixture.items():
                    worst[s] = max(worst.get(s, 0), abs(used[s] - x / sum(mixture.values()) * sum(used.values())))
        assert all(w < 1500 for w in worst.values()), (mixture, worst)
        again = packing.pack(df.repartition(7), mixture=mixture, width=512, block_tokens=8192).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_equal_rows_spread_over_blocks(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'the same words in every row' as text", "'a' as source")
    got = packing.pack(df, width=64, block_tokens=2048).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and sum(r["n"] for r in got) == 3000 * 7
    assert sum(r["n"] < 64 for r in got) <= -(-3000 * 7 // 2048)


def test_archives(spark):
    big = "<p>" + "é" * 80
    rows = [(3, "http://a/x y", big), (1, "http://b/", big), (2, None, big), (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "u", None), (1, "http://b/", big), (None, "n", "z" * 120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archives.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        page = [(u, h) for p, u, h in rows if p == r["page_id"]][0]
        raw = (page[1] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if r["page_id"] in (2, 3) else ("response", None))
    first = next(r for r in got if r["page_id"] == 1)
    assert all(r["refers_to_id"] == first["record_id"] for r in got if r["record_type"] == "revisit")
    assert archives.archive_round_trip(pages.where("false")).count() == 0
    assert len({r["record_id"] for r in got}) == len(rows)


def test_arc_records(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhi\nthere"
    for v in (1, 2):
        start = archives.arc_start(v, "f.arc", "20040101000000") + b"\n"
        content = start + archives.arc_header(v, "http://a/with blanks in it", "1.2.3.4", "20040101000000", "text/html", len(body), 0, "f.arc") + body + b"\n"
        content += archives.arc_header(v, "dns:a.example", "5.6.7.8", "20040102030405", "text/dns", 9, 0, "f.arc") + b"some dns\n" + b"\n"
        (info, _), *records = archives.read_arc(content)
        assert info["URL"] == "filedesc://f.arc" and [c for _, c in records] == [body, b"some dns\n"] and records[0][0]["URL"] == "http://a/with blanks in it"
        out = [h for r in archives.converted(content, {}) for h, _ in archives.read_warc(r)]
        assert [h["warc-type"] for h in out] == ["warcinfo", "response", "resource"]
        assert out[1]["warc-target-uri"] == "http://a/with%20blanks%20in%20it" and out[1]["warc-ip-address"] == "1.2.3.4" and out[1].get("x-arc-result-code") == (None if v == 1 else "200")
        assert out[2]["content-type"] == "text/dns" and out[2]["warc-date"] == "2004-01-02T03:04:05Z" and out[2]["warc-warcinfo-id"] == out[0]["warc-record-id"]
        assert [c for _, c in archives.read_arc(archives.gzip.compress(content))] == [c for _, c in archives.read_arc(content)]
    for broken in (b"http://a/ 1 2\n", start + b"http://a/ 1.2.3.4 x y z\n", start + b"http://a/ 1.2.3.4 2004 text/html 99\nshort"):
        with pytest.raises(ValueError):
            list(archives.read_arc(broken))


def test_archives_with_hot_payloads_and_odd_columns(spark, tmp_path, monkeypatch):
    big = "é" * 90
    pages = spark.range(300).selectExpr("id as page_id", "'http://a/' as url", f"case when id % 3 = 0 then '{big}' when id % 3 = 1 then repeat(cast(id % 10 as string), 200) else repeat('x', 10000) || id end as html", "1 as digest", "'x' as file", "2 as n").unionByName(spark.sql(f"select cast(null as long) as page_id, 'u' as url, '{big}' as html, 1 as digest, 'x' as file, 2 as n union all select null, 'u', 'other', 1, 'x', 2"))
    monkeypatch.setattr(archives, "ARC_BYTES", 20_000)
    out = []
    for copies, payloads in ((10_000, 100), (50, 100), (2, 0)):
        monkeypatch.setattr(archives, "HOT_COPIES", copies)
        monkeypatch.setattr(archives, "HOT_PAYLOADS", payloads)
        got = archives.archive_round_trip(pages).collect()
        assert len({r["record_id"] for r in got}) == 302
        out.append(sorted((str(r["page_id"]), r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))
        assert collections.Counter(r["record_type"] for r in got) == {"response": 1 + 10 + 100 + 1, "revisit": 99 + 90 + 1}
    assert out[0] == out[1] == out[2]
    # Each record is a member of its own.
    warc = str(tmp_path / "warc")
    archives.write_arc(pages, str(tmp_path / "arc"))
    archives.convert(spark, str(tmp_path / "arc"), warc)
    import glob
    import zlib as z

    for f in glob.glob(warc + "/part-*"):
        raw = open(f, "rb").read()
        while raw:
            d = z.decompressobj(31)
            text, raw = d.decompress(raw), d.unused_data
            assert text == b"" or len(list(archives.read_warc(text))) == 1


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_decontamination(spark, docs, rows, none, block):
    base = texts()[3]
    items = [(1, " ".join(base.split(" ")[10:40])), (1, "ONE two"), (10, "one two"), (2, None), (3, "..."), (None, base), (4, " ".join(base.split(" ")[30:70]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: TERM.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        if k is not None and w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(k))
    want = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        want.append((str(r[0]), (len(hit) > 0 and 20 * len(hit) >= len(w), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit), len(found), len(w))))
    got = decontaminate.judged(decontaminate.find_hits(docs, benchmark, keep=["doc_id"], block_windows=block)).drop("hits", "items")
    assert as_bag(got) == sorted(want)
    kept = decontaminate.decontaminate(docs, benchmark, block_windows=block)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    left = collections.Counter((str(r["doc_id"]), r["text"], r["n_chars"]) for r in kept.collect())
    cut = collections.Counter()
    for r, w in zip(rows, want):
        if not w[1][0]:
            said = [m.span() for m in TERM.finditer(r[1] or "")]
            hit = {i + j for n in {len(x) for x in windows} for i in range(len(said) - n + 1) if tuple(words(r[1])[i : i + n]) in windows for j in range(n)}
            runs = [i for i in sorted(hit) if i - 1 not in hit]
            t, back = r[1], 0
            for i in reversed(runs):
                j = next(j for j in range(i, len(said)) if j + 1 not in hit)
                t, back = t[: said[i][0]] + t[said[j][1] :], 1
            cut[(str(r[0]), t, len(t) if back else r[4])] += 1
    assert left == cut
    assert decontaminate.decontaminate(none, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.where("false")).count() == len(rows)


def test_window_blocks_are_small(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(400))) for i in range(300)]
    rows = decontaminate._windows(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 13).toArrow()
    block = decontaminate.WindowSet(rows)
    assert len(block) == 300 * 388
    assert block.nbytes() < 110 * len(block)  # of which about 75 are the window's words


def test_licenses(docs, rows, none):
    got = {str(r["doc_id"]): r for r in licenses.scan_licenses(docs).collect()}
    for r in rows:
        w = TERM.findall((r[1] or "").translate(LOWER))
        at = sorted(i for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        base = {label for p, label in licenses.PHRASES.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
        g = got[str(r[0])]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)))
        assert base <= set(filter(None, g["labels"].split(","))) and 0 <= g["score"] <= 1
    gpl = next(r for r in got.values() if "gpl" in r["base_labels"])
    assert gpl["labels"] == "gpl,gpl-3.0,reserved" and gpl["score"] == 1.0
    assert licenses.scan_licenses(none).count() == 0


def test_automaton_against_regex():
    rng = random.Random(1)
    markup = "a <<beginOptional>>b c<<endOptional>> d <<var;max=2>> e <<beginOptional>>f<<endOptional>>"
    machine = licenses.Automaton("t", markup)
    pattern = re.compile(r"a( b c)? d( \w+){0,2} e( f)?(?= |$)")
    for _ in range(3000):
        words = [rng.choice("abcdef") for _ in range(rng.randrange(1, 9))]
        accepted = [n for n in range(1, len(words) + 1) if pattern.fullmatch(" ".join(words[:n]))]
        assert machine.run(words)[0] == max(accepted, default=0)


def as_regex(markup):
    """A template as a regular expression over words, each followed by a blank."""
    out = ""
    for m in re.finditer(r"<<beginOptional>>|<<endOptional>>|<<var;([^<>]*)>>|[0-9a-z]+", re.sub(r"^(<<var;[^<>]*max=[^<>]*>> ?)+", "", markup)):
        if m[0].startswith("<<begin"):
            out += "(?:"
        elif m[0].startswith("<<end"):
            out += ")?"
        elif m[1]:
            parts = dict(x.split("=") for x in m[1].split(";"))
            out += f"(?:{parts['match']}) " if "match" in parts else rf"(?:\S+ ){{0,{parts['max']}}}"
        else:
            out += m[0] + " "
    return re.compile(r"(?:^|(?<= ))" + out)


def test_license_labels_against_regex(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice(["some", "words", "here", "this", "under", "redistribution"]) for _ in range(n))

    def said(markup, change):
        words = []
        for m in re.finditer(r"<<beginOptional>>(.*?)<<endOptional>>|<<var;([^<>]*)>>|[0-9a-z]+", markup):
            if m[2]:
                words += m[2].rsplit("match=")[-1].split("|")[:1] if "match=" in m[2] else fill(rng.randrange(3)).split()
            elif m[0].startswith("<<"):
                words += re.sub(r"<<var;[^<>]*>>", "thing", m[1]).split() * rng.randrange(2)
            else:
                words.append(m[0])
        if change:
            words[rng.randrange(len(words) * 2 // 3, len(words))] = "altered"
        return f"{fill(rng.randrange(6))}\n\n{'; '.join(words).upper() if rng.random() < 0.5 else ' '.join(words)}. {fill(5)}"

    own = [("lead", "<<var;name=who;max=4>> grants you rights <<var;name=how;match=freely|gladly>>")]
    templates = licenses.TEMPLATES + own
    texts_ = [said(m, change) for _, m in templates for change in (False, False, True)] + [None, "", "the mit license", "under the mit license"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string"), templates=templates).collect()
    known = [(label, as_regex(m)) for label, m in templates]
    for r in got:
        words = "".join(w + " " for w in TERM.findall((texts_[r["doc_id"]] or "").translate(LOWER)))
        base = {label for p, label in licenses.PHRASES.items() if p + " " in words}
        want = {label for label, pattern in known if pattern.search(words)}
        assert r["labels"] == ",".join(sorted(want | base)), texts_[r["doc_id"]]
        assert (r["score"] == 1.0) == bool(want)
    assert {label for label, _ in templates} <= {x for r in got for x in r["labels"].split(",")}


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d}"
    changes = spark.createDataFrame([("host", "A.example", "x", day(2), "add"), ("host", "a.example", "x", day(5), "remove"), ("host", "a.example", "x", day(8), "add"), ("domain", "example", "t", day(3), "add"), ("host", None, "x", day(1), "add"), ("host", "b.other", "x", day(4), "add"), ("host", "b.other", "x", day(4), "remove")], "kind string, pattern string, category string, at string, action string").withColumn("at", F.to_date("at"))
    captures = spark.createDataFrame([(i, u, day(d)) for i, (u, d) in enumerate([("http://u@A.example:80/x", 1), ("http://a.example", 2), ("https://a.example./", 5), ("http://a.example/", 9), ("http://b.example", 3), ("http://b.other", 6), (None, 3), ("nohost", 3)])] + [(8, "http://a.example", None)], "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched"))
    want = ["", "x", "t", "t,x", "t", "", "", "", ""]
    for bound in (url_filters.BROADCAST_ROWS, 0):
        keep, url_filters.BROADCAST_ROWS = url_filters.BROADCAST_ROWS, bound
        try:
            got = {r["page_id"]: r for r in url_filters.filter_urls(captures, changes).collect()}
        finally:
            url_filters.BROADCAST_ROWS = keep
        odd = url_filters.filter_urls(captures.withColumns({"__key": F.lit(1), "host": F.lit("x"), "kind": F.lit("y"), "salt": F.lit(3), "categories": F.lit(0)}), changes.withColumn("note", F.lit(1)))
        assert odd.columns == ["page_id", "fetched", "host", "categories", "n_entries", "blocked"] and {r["page_id"]: r for r in odd.collect()} == got
        assert [got[i]["categories"] for i in range(9)] == want and [got[i]["blocked"] for i in range(9)] == [w != "" for w in want]


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf(dict):
        getAll = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m"}

        def contains(self, key):
            return False

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: Conf()})()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(Session())


def groups_of(rows, up=80, down=100, shingle=5):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append(frozenset(zip(*[w[i:] for i in range(shingle)])) if len(w) >= shingle else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    key = [(-(2**63) if r[0] is None else r[0]) for r in rows]
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            a, b = sets[i], sets[j]
            if a and b and down * len(a & b) >= up * len(a | b) and key[label[i]] != key[label[j]]:
                low = min(label[i], label[j], key=lambda x: key[x])
                label = [low if x in (label[i], label[j]) else x for x in label]
                changed = True
    return [(len(s), key[label[i]]) for i, s in enumerate(sets)], key


@pytest.mark.parametrize("members, shingle", [(1024, 4), (4, 4), (3, 5), (1024, 5)])
def test_near_dedup(spark, docs, rows, none, members, shingle):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    more = []
    for i in range(30):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        more.append((100 + i, " ".join(words), "en", "a", 1, 7, "h", "n"))
    table = [*rows, *more]
    want, key = groups_of(table, shingle=shingle)
    df = spark.createDataFrame(table, SCHEMA)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(df, members=members, shingle=shingle).collect())
    name = lambda k: str(None if k == -(2**63) else k)
    assert got == sorted((name(k), n, name(c), k == c) for k, (n, c) in zip(key, want))
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_first(df, members=members, shingle=shingle).count() == len({k for k, (_, c) in zip(key, want) if k == c})


@pytest.mark.parametrize("last", [20_000, 30, 0])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(near_dedup, "LAST_LINKS", last)
    rng = random.Random(3)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = [(i, i + 1) for i in range(40)] + list(zip(chain, chain[1:])) + [(500, i) for i in range(501, 560)] + [(i, 700) for i in range(640, 700)] + [(9000, 9000), (9001, 9002), (9002, 9001), (9001, 9002)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == label and len(got) == len(label)
    assert near_dedup.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_large_group_needs_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(1500)]
    for i in range(40):  # far from the base text, some close to each other
        words = [f"v{i // 2}x{j}" for j in range(60)]
        rows.append((5000 + i, " ".join([*base[:30], *words, f"z{i}"])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    dealt, real = [], near_dedup._dealt

    def counted(*args, **options):
        out = real(*args, **options)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_dealt", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, members=128).collect()}
    assert all(got[i] == 0 for i in range(1500)) and all(got[5000 + i] == 5000 + i // 2 * 2 for i in range(40))
    assert sum(dealt) < 8 * len(rows)  # all pairs of blocks would deal each row to 12 tasks and more


def test_needed_matches_never_drop_at_threshold():
    rng = np.random.default_rng(0)
    lost, needed = 0, near_dedup.needed_matches()
    for _ in range(2000):
        agree = rng.random(near_dedup.HASHES) < 0.8
        lost += any(agree[:n].sum() < low for n, low in needed)
    assert lost <= 2
    tail = lambda n, m: sum(math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m))
    assert sum(tail(n, m) for n, m in needed) < 6e-6


def test_near_dedup_shingle_width(spark, tmp_path):
    import corpus_pipeline
    from fieldweave.llm import queries

    base = [f"w{i}" for i in range(150)]
    far = list(base)
    for i in (30, 60, 90, 120):  # similarity 131 / 163 with four words, 126 / 166 with five
        far[i] = f"n{i}"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(far)), (3, " ".join([*base, "z"]))], "doc_id long, text string")
    kept = lambda d: sorted(r["doc_id"] for r in d.collect())
    assert [kept(near_dedup.near_duplicates(df, shingle=n).where("kept")) for n in (4, 5)] == [[1], [1, 2]]
    assert [kept(near_dedup.keep_first(df, shingle=n)) for n in (4, 5)] == [[1], [1, 2]]
    assert kept(corpus_pipeline.minhash_dedup(spark, df, "")) == [1, 2]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert kept(queries.op10_minhash(spark, str(tmp_path)).where("kept")) == [1]


def test_special_tokens_are_one_id(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path())
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids
    assert ids("a <|endoftext|> b") == [320, 49407, 321]
    odd = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>x <|startoftext|>", "<|ENDOFTEXT|> <|endoftext| > <|endoftext|", "It's<|endoftext|>\u0301É", "<|endoftext|><|startoftext|>", "<|endof", "text|>", "12<|endoftext|>.\n#<|endoftext|>", "\xa0<|endoftext|>\u3000", *texts()]
    e = tokens.encoder(tokens.tokenizer_path())
    for _ in range(2):
        got, at = e.encode(*columnar.text_buffer(pa.array(odd)))
        assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [ids(t) for t in odd]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(odd)], "doc_id long, text string, source string")
    start = np.cumsum([0, *[len(ids(t)) + 1 for t in odd]]).tolist()
    want = [(i, start[i], len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for i, t in enumerate(odd)]
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(df).collect()) == want
    for r in packing.pack(df, width=64).collect():
        whole = [*ids(odd[r["doc_id"]]), 1]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(whole), zlib.crc32(np.array(whole[r["start"] : r["start"] + r["length"]], "<u4").tobytes()))


def test_keep_first_without_or_with_repeated_keys(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(100))
    a, b, c, d, f = map(long, "abcdf")
    rows = [(None, a, 1), (None, a + " end", 2), (5, a, 3), (None, b, 4), (7, c, 5), (7, d, 6), (7, d, 6), (7, c + " end", 7), (8, d + " end", 8), (9, f, 9), (None, None, 10), (None, "", 11), (None, " \n", 12), (9, "", 13), (9, "", 13), (10, "", 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = near_dedup.keep_first(df)
    assert got.columns == df.columns
    kept = collections.Counter(r["n"] for r in got.collect())
    assert max(kept.values()) == 1
    groups = [{1, 2}, {4}, {5, 7}, {6}, {9}, {10}, {11}, {12}, {13}, {14}]
    assert set(kept) <= set().union(*groups) and [len(g & set(kept)) for g in groups] == [1] * len(groups)
    for _ in range(2):
        assert set(kept) == {r["n"] for r in near_dedup.keep_first(df.repartition(2)).collect()}
