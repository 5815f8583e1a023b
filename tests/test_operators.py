"""Operators on small tables: scores and quantiles, topics over chunks, trees, headers, evaluation, files, whole runs."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import text
from fieldweave.operators import assign, ctfidf, evaluate, headers, records, trees
from fieldweave.plans import mapping, pipelines
from fieldweave.sources import files, sinks


def vectors(spark, n, size, seed, key="id"):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"{i:03d}", [float(x) for x in rng.normal(size=size)]) for i in range(n)], f"{key} string, embedding array<float>")


@pytest.mark.parametrize("at_once", [4096, 3])
def test_best_anchors_equal_all_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(assign, "ANCHORS_AT_ONCE", at_once)
    docs, anchors = vectors(spark, 40, 6, 1), vectors(spark, 8, 6, 2, "anchor_id")
    anchors = anchors.unionByName(anchors.where("anchor_id = '003'").withColumn("anchor_id", F.lit("900")))  # a tie
    odd = spark.createDataFrame([("none", None), ("short", [1.0]), ("zero", [0.0] * 6)], "id string, embedding array<float>")
    scores = assign.score_pairs(docs, anchors).withColumn("score", F.round("score", 9))
    want = {r["id"]: r for r in assign.top_k(scores, 3).collect()}
    got = {r["id"]: r for r in assign.best_anchors(docs.unionByName(odd), anchors, 3, digits=9).collect()}
    for k, r in want.items():
        assert [(b["anchor_id"], b["score"]) for b in got[k]["best"]] == [(b["anchor_id"], b["score"]) for b in r["best"]] and got[k]["margin"] == r["margin"]
    assert [got[k]["top1"] for k in ("none", "short", "zero")] == [None, None, 0.0] and got["none"]["best"] == []
    judged = {r["id"]: r["n_labels"] for r in assign.classify_goals(assign.best_anchors(docs.unionByName(odd), anchors, 2)).collect()}
    assert judged["none"] == 0 and len(judged) == 43


def test_best_anchors_move_no_pairs(spark):
    plan = assign.best_anchors(vectors(spark, 40, 6, 1), vectors(spark, 8, 6, 2, "anchor_id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_quantiles_by_zooming(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), 0.5, -1e9, 1e-12, None])) for _ in range(700)] + [("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.33, 0.8, 1.0):
        whole, by = assign.quantile(df, "v", q).first(), {r["g"]: (r["n"], r["cut"]) for r in assign.quantile(df, "v", q, "g").collect()}
        monkeypatch.setattr(assign, "EXACT_ROWS", 10)
        monkeypatch.setattr(assign, "BINS", 8)
        assert assign.quantile(df, "v", q).first() == whole
        assert {r["g"]: (r["n"], r["cut"]) for r in assign.quantile(df, "v", q, "g").collect()} == by
        monkeypatch.undo()


def test_coverage_counts(spark):
    xs = [i / 500 for i in range(0, 501, 7)] + [0.1, 0.3, 0.7, -0.2, 1.5, None]
    top = spark.createDataFrame([(x, x) for x in xs], "top1 double, margin double")
    got = {r["cut"]: r["coverage"] for r in assign.coverage_curve(top).collect()}
    known = [x for x in xs if x is not None]
    assert len(got) == 501 and all(c == sum(x >= cut for x in known) / len(known) for cut, c in got.items())
    sweep = assign.coverage_sweep(top, [0, 0.5, 1], [0.2, 0.4], (0.3,)).collect()
    assert len(sweep) == 7 and all(abs(r["coverage"] - sum(x >= r["cut"] for x in known) / len(known)) < 1e-12 for r in sweep)
    with pytest.raises(Exception, match="without a document"):
        assign.align(spark.createDataFrame([(1, 2)], "id int, x int"), spark.createDataFrame([(5, 2)], "id int, v int"), strict=True).collect()
    with pytest.raises(ValueError):
        assign.align_by_place(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(5,)], "id int"))


@pytest.mark.parametrize("order", ["n", "s"])
def test_ngrams_cross_documents_and_chunks(spark, monkeypatch, order):
    monkeypatch.setattr(ctfidf, "CHUNK_ROWS", 4)
    rng = random.Random(5)
    rows = [(i, f"{i:03d}", rng.choice("xy"), " ".join(rng.choice(["aa", "bb", "the", "cc"]) for _ in range(rng.randrange(0, 4)))) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, s string, c string, t string")
    want = {}
    for c in "xy":
        stream = [t for r in rows if r[2] == c for t in r[3].split() if t != "the"]
        for n in (1, 2, 3):
            for i in range(len(stream) - n + 1):
                k = (c, " ".join(stream[i : i + n]))
                want[k] = want.get(k, 0) + 1
    got = ctfidf.counts(df, cls="c", text="t", order=order, pattern=ctfidf.PATTERN_PLAIN, stop=["the"], ngram_max=3)
    assert {(r["class"], r["term"]): r["n"] for r in got.collect()} == want


def test_no_window_over_a_class_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(ctfidf, "CHUNK_ROWS", 1)
    df = spark.createDataFrame([(1, "c", "aa bb"), (2, "c", "bb")], "n int, c string, t string")
    plan = ctfidf.class_tfidf(df, cls="c", text="t", order="n", min_df=1)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "collect_list(_h#" in line]
    assert windows and all(line.count("[class#") + line.count("[_c#") and "_c#" in line for line in windows)


def test_deep_trees(spark):
    deep = "1"
    for i in range(40):
        deep = json.dumps({"k": json.loads(deep)} if i % 2 else [json.loads(deep)])
    rows = [(1, deep), (2, "broken {"), (3, None), (4, '{"b": [true, null, 1.5, "é"], "a": {}}'), (5, "[NaN]"), (6, "7")]
    got = trees.walk(spark.createDataFrame(rows, "id int, j string"), "j", ["id"]).collect()
    assert sum(r["id"] == 1 for r in got) == 40 and max((r for r in got if r["id"] == 1), key=lambda r: len(r["path"]))["value"] == "1"
    four = {"/".join(r["path"]): (r["kind"], r["value"], r["pos"]) for r in got if r["id"] == 4}
    assert four == {"a": ("object", None, 0), "b": ("array", None, 1), "b/0": ("leaf", "true", 0), "b/1": ("leaf", None, 1), "b/2": ("leaf", "1.5", 2), "b/3": ("leaf", "é", 3)}
    assert {r["id"] for r in got} == {1, 4}


def test_xml_mixed_content(spark):
    rows = [(1, '<r><n name="A">x<b/>y</n><n name="B">z</n><n name="C"> </n><n>w</n></r>'), (2, "<broken"), (3, None)]
    got = trees.xml_records(spark.createDataFrame(rows, "id int, x string"), "x", ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, "A", "xy"), (1, 1, "B", "z")]


def test_header_columns_equal_header_functions(spark):
    names = ["id", "Metadata_id", "Metadata_general_titleType_title_#text", "Metadata_contactsType_firstName_FirstName_#text", "a_b-c_dEfStatus_gH_iJ_kLM", "Ärger_ütMehr_#text", "x__y", "", "metadata", "don't_stop2go"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", headers.simple_header_column(F.col("n")).alias("a"), headers.short_header_column(F.col("n")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(headers.simple_header(r["n"]), headers.short_header(r["n"])) for r in got]


def test_blanks_are_those_of_python(spark):
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    said = [f"{b}A{b}{b}b{b}" for b in blanks] + ["a​b", "x⁠y"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.norm_text(F.col("s")).alias("t"), text.split_multivalue(F.concat("s", F.lit(" ;"), "s")).alias("p"), text.rouge_l(F.col("s"), F.lit("a b")).alias("r")).collect()
    for r in got:
        assert r["t"] == " ".join(r["s"].lower().split())
        assert r["p"] == [r["t"]]
    assert all(r["r"]["f1"] == 1.0 for r in got[: len(blanks)])


def test_evaluation_joins_over_no_break_spaces(spark):
    pred = spark.createDataFrame([("1", "Phylogenetic groups; soil", " Yes "), ("2", "x", "no")], "id string, keywords string, review string")
    gold = spark.createDataFrame([("1", "phylogenetic groups,soil ", "yes"), ("2", "y; x", "yes")], "id string, keywords string, review string")
    by = {r["field"]: r for r in evaluate.evaluate(pred, gold).collect()}
    assert (by["keywords"]["micro_precision"], by["keywords"]["micro_recall"], by["keywords"]["subset_accuracy"], by["keywords"]["avg_jaccard"]) == (1.0, 0.75, 0.5, 0.75)
    assert (by["review"]["tp"], by["review"]["fn"]) == (1, 1)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "n int, s string, x double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert dict(files.read_csv(spark, str(tmp_path / "c"), types=True).dtypes) == {"n": "int", "s": "string", "x": "double"}
    with pytest.warns(UserWarning, match="no file"), pytest.raises(ValueError):
        files.read_documents(spark, [str(tmp_path / "none.csv")])
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"id": "1"}\n\n' + "x" * 500 + "\n")
    (tmp_path / "j" / "b.jsonl").write_text('{"id": "2"}\n')
    got = {(r["id"], r["line"], len(r["error"] or "")) for r in files.read_json_lines(spark, str(tmp_path / "j")).collect()}
    assert got == {("1", 1, 0), (None, 3, 517), ("2", 1, 0)}
    calls = files.fetch(spark.createDataFrame([("1",), ("x",)], "id string"), lambda k: json.dumps({"id": int(k)}), attempts=2).orderBy("id").collect()
    assert calls[0]["body"] == '{"id": 1}' and calls[1]["body"] is None and "ValueError" in calls[1]["error"]
    made = []
    build = lambda: made.append(1) or df
    for _ in range(2):
        assert files.built(spark, str(tmp_path / "b"), build).count() == 2
    assert made == [1]
    assert sinks.preview(df, 1) == "n\ts\tx\n1\ta\t1.5"


def test_natural_datatypes(spark):
    ttl = """@prefix rr: <http://www.w3.org/ns/r2rml#> .
    <#A> a rr:TriplesMap ; rr:logicalTable [ rr:tableName "t" ] ; rr:subjectMap [ rr:template "http://e.org/{i}" ] ;
      rr:predicateObjectMap [ rr:predicate <http://e.org/p> ; rr:objectMap [ rr:column "i" ] , [ rr:column "d" ] , [ rr:column "b" ] , [ rr:column "w" ] , [ rr:column "s" ] , [ rr:column "d" ; rr:datatype <http://e.org/own> ] ] ."""
    t = spark.sql("select 1 as i, date'2024-01-02' as d, true as b, cast(1.5 as decimal(5, 2)) as w, 'x' as s")
    got = {(r["object"], (r["datatype"] or "").rsplit("#", 1)[-1]) for r in mapping.compile_mapping(spark, mapping.read_mapping(ttl), {"t": t}).collect()}
    assert got == {("1", "integer"), ("2024-01-02", "date"), ("true", "boolean"), ("1.50", "decimal"), ("x", ""), ("2024-01-02", "http://e.org/own")}


def test_embedding_retries_and_refinement(spark, tmp_path):
    flag = str(tmp_path / "tried")

    def unsteady(texts):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("busy")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("a", "xyz"), ("b", None)], "id string, text string").coalesce(1)
    assert {r["id"]: list(r["embedding"]) for r in records.embed(df, unsteady, wait=0.01).collect()} == {"a": [3.0, 1.0], "b": [0.0, 1.0]}
    with pytest.raises(Exception, match="always"):
        records.embed(df, lambda t: (_ for _ in ()).throw(RuntimeError("always")), attempts=2, doubling=True).collect()
    topics = spark.createDataFrame([(1, 3, "soil; tree"), (2, 2, "")], "class int, n_docs long, top_terms string")
    words = spark.createDataFrame([(1, "soil")], "class int, keyword string")

    def ask(system, user):
        if "keyword" in user:
            raise RuntimeError("no answer")
        return " A sentence. " if "soil" in user else " "

    got = {r["class"]: (r["keyword"], r["sentence"]) for r in pipelines.refine_with(ctfidf.refine(topics, words), topics, ask).collect()}
    assert got == {1: ("soil", "A sentence."), 2: (None, "This cluster groups related publications and datasets.")}


@pytest.mark.parametrize("n", [1, 3])
def test_class_tfidf_written_and_whole(spark, monkeypatch, n):
    """Written tables and many small steps: scores of a plain count, absent terms and negative scores included; nothing that a scan makes is larger than the terms that count."""
    for name, value in (("LAZY_ROWS", 0), ("CHUNK_ROWS", 7), ("AT_ONCE", 40)):
        monkeypatch.setattr(ctfidf, name, value)
    rng = random.Random(7)
    words = ["aa", "bb", "the", "cc", "dd", "über", "zz"]
    rows = [(i, f"c{rng.randrange(4)}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(120)] + [(500, None, "aa"), (501, "c9", "qq aa"), (502, "c8", "")]
    df = spark.createDataFrame(rows, "doc_id int, c string, t string")
    classes, count = sorted({r[1] for r in rows if r[1]}), {}
    for c in classes:
        stream = [t for r in rows if r[1] == c for t in r[2].split() if t != "the"]
        for m in range(1, n + 1):
            for i in range(len(stream) - m + 1):
                count.setdefault(" ".join(stream[i : i + m]), {}).setdefault(c, 0)
                count[" ".join(stream[i : i + m])][c] += 1
    for need, policy in ((3, "all"), (2, "non_empty")):
        k = len(classes) - (policy == "non_empty")  # c8 has no token
        known = {t: x for t, x in count.items() if len(x) >= need}
        want = []
        for c in classes:
            if policy == "non_empty" and c == "c8":
                continue
            total = sum(x.get(c, 0) for x in known.values())
            ranked = sorted(((-round(x[c] / total * math.log(k / (1 + len(x))), 12) if c in x else -0.0, t) for t, x in known.items()))
            want += [(c, t, round(-s, 9) + 0.0, i + 1) for i, (s, t) in enumerate(ranked)]
        for top in (6, None):
            got = ctfidf.class_tfidf(df, cls="c", text="t", stop=["the"], ngram_max=n, min_df=need, top_k=top, k_policy=policy).collect()
            assert sorted((r["class"], r["term"], round(r["score"], 9) + 0.0, r["rank"]) for r in got) == sorted(w for w in want if top is None or w[3] <= top)


def test_ngrams_are_shuffled_without_text(spark, monkeypatch):
    """Most n-grams stand in one class: they go before they are joined, and no text of theirs is shuffled."""
    rng = random.Random(11)
    rows = [(i, f"c{i % 6}", " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id int, c string, t string")
    plan = ctfidf.class_tfidf(df, cls="c", text="t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Relation" in plan
