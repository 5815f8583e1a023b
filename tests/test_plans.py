"""Mappings, clusters, joins and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import assign, cluster
from fieldweave.operators.joins import disjunctive_join
from fieldweave.plans import mapping
from fieldweave.sources import files, sinks

TTL = """
@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix ex: <http://e.org/> .
# a comment with <iri> and [brackets]
<#A> a rr:TriplesMap ; rr:logicalTable [ rr:tableName "t" ] ;
  rr:subjectMap [ rr:template "http://e.org/{gate}_{id}" ; rr:class ex:C ] ;
  rr:predicateObjectMap [ rr:predicate ex:p, ex:obi:q ; rr:objectMap [ rr:template "l {name}" ; rr:language "en" ] ; ] ;
  rr:predicateObjectMap [ rr:predicate ex:r ; rr:object ex:k ; rr:graphMap [ rr:template "g{id}" ] ] .
"""


def test_mapping(spark):
    maps = mapping.read_mapping(TTL)
    t = spark.createDataFrame([(1, "x y", "n"), (2, None, "n"), (3, "z", None)], "id int, gate string, name string")
    quads = {(r["graph"], r["subject"], r["predicate"], r["object"], r["lang"]) for r in mapping.compile_mapping(spark, maps, {"t": t}).collect()}
    a, b = "http://e.org/x%20y_1", "http://e.org/z_3"
    assert quads == {
        ("", a, mapping.RDF_TYPE, "http://e.org/C", None), ("", b, mapping.RDF_TYPE, "http://e.org/C", None),
        ("", a, "http://e.org/p", "l n", "en"), ("", a, "http://e.org/obi:q", "l n", "en"),
        ("g1", a, "http://e.org/r", "http://e.org/k", None), ("g3", b, "http://e.org/r", "http://e.org/k", None),
    }


def test_n_quads_round_trip(spark):
    q = spark.createDataFrame([("g", "s", "p", 'a "b"\n', "literal", "en", None), ("", "s", "p", "o", "iri", None, None)], "graph string, subject string, predicate string, object string, object_kind string, lang string, datatype string")
    assert {r["value"] for r in mapping.n_quads(q).collect()} == {'<s> <p> "a \\"b\\"\\n"@en <g> .', "<s> <p> <o> ."}
    assert list(mapping.triples('<s> <p> "x"@de , <o> .')) == [("s", "p", ("literal", "x", "de", None)), ("s", "p", ("iri", "o"))]


def test_disjunctive_join_equals_or(spark):
    left = spark.createDataFrame([(1, "a", "b"), (2, "b", "b"), (3, "x", None)], "n int, u string, v string")
    right = spark.createDataFrame([("a", "c"), ("b", "d")], "k string, m string")
    for how in ("inner", "left"):
        got = disjunctive_join(left, right, [(F.col("u"), "k"), (F.col("v"), "k")], how)
        want = left.join(right, (F.col("u") == F.col("k")) | (F.col("v") == F.col("k")), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_linkage_and_density():
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:4]
    x = np.concatenate([c + rng.normal(0, 0.02, (15, 6)) for c in centres])
    k, labels = cluster.choose_k(x, kmin=2, kmax=8)
    assert k == 4 and all(len(set(labels[i * 15 : i * 15 + 15])) == 1 for i in range(4))
    noisy = np.concatenate([x, rng.uniform(-3, 3, (5, 6)) + 20])
    found = cluster.density_labels(noisy, 8)
    assert len(set(found[:60]) - {-1}) == 4 and (found[60:] == -1).all()


def test_linkage_against_plain_search():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 4))
    u = cluster.unit_rows(x)
    groups = [[i] for i in range(20)]
    while len(groups) > 5:
        pairs = [(np.mean([1 - u[a] @ u[b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    labels = cluster.cut(cluster.average_linkage(x), 20, 5)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == c).tolist()) for c in range(5)}


@pytest.mark.parametrize("task", [True, False])
def test_linkage_and_density_of_many(spark, monkeypatch, task):
    """Lists of few nearest points, searched again when they are used up, give the labels of all pairs."""
    for name, value in (("NEAR", 3), ("ROWS", 16), ("COLUMNS", 32), ("AT_DRIVER", 0 if task else 10**9)):
        monkeypatch.setattr(cluster, name, value)
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(0, 0.25, (25, 5)) for c in np.eye(5)[:4]] + [rng.uniform(-1, 1, (12, 5))])
    x = np.concatenate([x, x[:7], x[:3]])  # copies
    merges, plain = cluster.linkage_of_many(spark, x), cluster.average_linkage(x)
    assert len(merges) == len(x) - 1 and np.allclose([m[2] for m in merges], [m[2] for m in plain])
    assert all((cluster.cut(merges, len(x), k) == cluster.cut(plain, len(x), k)).all() for k in (2, 5, 12, 40))
    for m in (2, 5, 9):
        found = cluster.condensed(cluster.tree_of_many(spark, x, m), len(x), m)
        assert (found == cluster.density_labels(x, m)).all()


def test_clusters_past_one_task(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([c + rng.normal(0, 0.1, (15, 4)) for c in np.eye(4)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    for f in (lambda most: cluster.super_anchors(df, key="id", vec="v", kmin=2, kmax=8, most=most), lambda most: cluster.density_clusters(df, key="id", vec="v", min_cluster_size=5, most=most)):
        assert f(20).schema == f(100).schema and sorted(map(tuple, f(20).collect())) == sorted(map(tuple, f(100).collect()))


def test_goal_defaults_accept_all(spark):
    scores = spark.createDataFrame([(1, "a", 0, 0.01), (1, "b", 1, 0.01), (2, "a", 0, 0.5), (2, "b", 1, 0.1)], "id int, anchor_id string, idx int, score double")
    rows = {r["id"]: r for r in assign.classify_goals(scores).collect()}
    assert rows[1]["goal1_id"] == "a" and rows[1]["n_labels"] == 1 and rows[2]["margin"] == 0.4
    assert assign.classify_goals(scores, min_margin=2.0).where("n_labels > 0").count() == 1


def test_goal_defaults_accept_negative_scores(spark):
    scores = spark.createDataFrame([(1, "a", 0, -0.2), (1, "b", 1, -0.3), (2, "a", 0, -0.5), (2, "b", 1, 0.3)], "id int, anchor_id string, idx int, score double")
    assert {r["id"]: (r["n_labels"], r["goal1_id"]) for r in assign.classify_goals(scores, multi_margin=0.2, multi_min_top1=0.1).collect()} == {1: (1, "a"), 2: (1, "b")}
    assert {r["id"]: r["n_labels"] for r in assign.classify_goals(scores, margin_min_top1=0.1).collect()} == {1: 0, 2: 1}


def test_sources(spark, tmp_path):
    p = tmp_path / "goals.csv"
    p.write_text('id,label,text\n1,"a","x\n\ny"\n2,,z\n')
    df = files.read_csv(spark, str(p), strings=True)
    assert sorted(tuple(r) for r in df.collect()) == [("1", "a", "x\n\ny"), ("2", "", "z")]
    with pytest.raises(ValueError):
        files.need(df, ["missing"])
    j = tmp_path / "raw.jsonl"
    j.write_text('{"id": "1", "raw": "{}"}\nbroken\n')
    assert [r["error"] for r in files.read_json_lines(spark, str(j)).orderBy("id").collect()] == ["unreadable line: broken", None]
    c = tmp_path / "c.json"
    c.write_text('{"k": {"definition": "d", "allowed": ["a"], "raw_allowed": "a; b"}}')
    assert [tuple(r) for r in files.read_catalogue(spark, str(c)).collect()] == [("k", "d", "a; b")]
    sinks.write_csv(df, str(tmp_path / "out"), ["text", "none"], blank=True)
    assert files.read_csv(spark, str(tmp_path / "out")).columns == ["text", "none"]


def test_distinct_spreads_with_the_input(spark, monkeypatch, tmp_path):
    """Much input is dealt to tasks by its size before any table of rows is kept; a left join's row numbers are read from one table."""
    from fieldweave.operators import joins

    spark.range(3000).selectExpr("id % 700 as a", "if(id % 3 = 0, null, 'x') as b").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = joins.distinct(df)
    monkeypatch.setattr(joins, "TASK_BYTES", 100)
    spread = joins.distinct(df)
    assert "RepartitionByExpression" in spread._jdf.queryExecution().optimizedPlan().toString() and "Repartition" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert spread.rdd.getNumPartitions() > 8 and sorted(map(str, spread.collect())) == sorted(map(str, df.distinct().collect()))
    joined = disjunctive_join(df, spark.createDataFrame([(5, "m")], "k long, m string"), [(F.col("a"), "k")], "left")
    assert joined.count() == 3000 and "monotonically_increasing_id" not in joined._jdf.queryExecution().optimizedPlan().toString()
