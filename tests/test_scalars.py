"""Scalar semantics on hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import text as T
from fieldweave.operators import ctfidf, evaluate, headers, links, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: T.split_multivalue(F.lit("A ; b,None, a"), True), ["a", "b"]),
        (lambda: T.split_multivalue(F.lit("A ; b,None, a")), ["a", "b", "none"]),
        (lambda: T.split_multivalue(F.lit(None).cast("string")), []),
        (lambda: T.parse_yesno(F.lit("Yes; no")), "yes"),
        (lambda: T.parse_yesno(F.lit("1")), "yes"),
        (lambda: T.parse_yesno(F.lit("maybe")), "maybe"),
        (lambda: T.norm_text(F.lit("  A’\tB  ")), "a' b"),
        (lambda: F.round(T.sim_ratio(F.lit("kitten"), F.lit("sitting")), 6), round(1 - 3 / 7, 6)),
        (lambda: T.normalize_key(F.lit("Theory/Modeling (x)")), "theory_or_modeling_x"),
        (lambda: T.normalize_key_hyphen(F.lit("Theory/Modeling (x)")), "theory_modeling_x"),
        (lambda: T.title_abstract(F.lit("Title: T\nAbstract: A"))["title"], "T"),
        (lambda: T.title_abstract(F.lit("Title: T\nAbstract: A"))["abstract"], "A"),
        (lambda: T.lenient_json(F.lit('```json\n{"a": [1,],}\n```')), '{"a": [1]}'),
        (lambda: T.iri_safe(F.lit("a b/ü+*~é")), "a%20b%2Fü%2B%2A~é"),
        (lambda: T.allowed_answers(F.lit("A; b, a"))["enum"], ["A", "b"]),
        (lambda: T.allowed_answers(F.lit("INT"))["type"], "integer"),
        (lambda: T.first_word(F.lit(' "Soil," and more')), "Soil"),
        (lambda: T.word_list(F.lit("a, ,b")), ["a", "b"]),
        (lambda: F.size(T.greedy_pairs(F.array(F.lit("abc"), F.lit("abd")), F.array(F.lit("abc")), 0.6)), 1),
        (lambda: ctfidf.sentence(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), "This cluster focuses on a, b, and c."),
        (lambda: ctfidf.sentence(F.array().cast("array<string>")), "This cluster groups related publications and datasets."),
    ],
)
def test_scalars(spark, make, want):
    assert one(spark, make()) == want


def test_rouge(spark):
    s = one(spark, T.rouge_l(F.lit("a b c d"), F.lit("a c d")))
    assert (s["p"], s["r"], round(s["f1"], 6)) == (0.75, 1.0, round(6 / 7, 6))
    assert one(spark, T.rouge_l(F.lit("a"), F.lit("")))["f1"] == 0.0


@pytest.mark.parametrize(("value", "want"), [("true", "yes"), ("0", "no"), ('["x", "No"]', "no"), ('["x"]', "x"), ('"x"', ""), ("null", "")])
def test_to_yes_no(spark, value, want):
    assert one(spark, records.to_yes_no(F.parse_json(F.lit(value)))) == want


def test_normalize_type(spark):
    end = lambda t, i: F.struct(F.lit(t).cast("string").alias("type"), F.lit(i).cast("string").alias("typeId"))
    assert one(spark, links.normalize_type(end(None, "10"))) == "publication"
    assert one(spark, links.normalize_type(end(" Dataset ", None))) == "dataset"
    assert one(spark, links.normalize_type(end(" ", "x"))) is None


def test_headers():
    assert headers.short_header("Metadata_generalType_projectTitleType_#text") == "Project Title"
    assert headers.simple_header("a_b_#text") == "A B"
    assert headers.unique(["Id", "x", "Id"], {"Id": "Dataset Id"}) == ["Id", "x", "Dataset Id"]


def test_metrics(spark):
    cells = spark.createDataFrame([("f", "maybe", "no"), ("f", "yes", "yes"), ("f", None, "yes"), ("f", "no", "")], "field string, p string, g string")
    row = evaluate.yesno(cells).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 0, 1, 1)
    empty = spark.createDataFrame([("f", "", "")], "field string, p string, g string")
    assert evaluate.multilabel(empty).first()["avg_jaccard"] == 1.0
    assert evaluate.fuzzy(empty).first()["avg_soft_jaccard"] == 0.0
    numbers = spark.createDataFrame([("f", "3.9", "3"), ("f", "x", "1")], "field string, p string, g string")
    row = evaluate.numeric(numbers).first()
    assert (row["support"], row["exact_match"]) == (1, 1.0)


def test_last_wins_and_renames(spark):
    df = spark.createDataFrame([(" a ", 1), ("a", 2), ("", 3), (None, 4)], "id string, n int")
    assert [tuple(r) for r in evaluate.last_wins(df, "id", "n").collect()] == [("a", 2)]
    assert evaluate.parse_renames("a:b, c ,d:e:f") == {"a": "b", "d": "e:f"}


def test_sides_are_computed_once_a_row(spark):
    """Long and short sides give the subsequence of a plain table; normalising and parsing stand outside the loops over their results."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abcdef") for _ in range(n)), " ".join(rng.choice("abcdeg") for _ in range(m))) for n, m in [(0, 0), (0, 3), (3, 0), (7, 5), (40, 59), (30, 60), (60, 61), (80, 75), (5, 70)] for _ in range(3)]
    df = spark.createDataFrame(rows, "p string, g string")
    for r in df.select("p", "g", T.rouge_l(F.col("p"), F.col("g")).alias("s")).collect():
        a, b = r["p"].split(), r["g"].split()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert (r["s"]["p"], r["s"]["r"]) == (t[-1][-1] / len(a) if a else 0.0, t[-1][-1] / len(b) if b else 0.0)
    pairs = T.greedy_pairs(T.split_multivalue(F.col("p")), T.split_multivalue(F.col("g")))
    for c, word, most in ((T.rouge_l(F.col("p"), F.col("g")), "split(", 2), (pairs, "split(", 2), (links._sides(F.col("p")), "from_json(", 1)):
        assert df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count(word) == most
