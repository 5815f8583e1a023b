"""Queries on embeddings: scores, assignment, coverage, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assign, cluster

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, label, embedding: the mean vector of every label."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("anchor_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the even anchors; the others go by their ids."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("anchor_id")).distinct().where("anchor_id % 2 = 0").select("anchor_id", F.concat(F.lit("topic "), F.col("anchor_id").cast("string")).alias("label"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = assign.score_pairs(table(spark, sf_dir, "embeddings"), anchors(spark, sf_dir), doc_id="vec_id")
    return pairs.withColumn("score", F.round("score", 9))


def best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best anchors of every vector, with the scores that ``scores`` has."""
    return assign.best_anchors(table(spark, sf_dir, "embeddings"), anchors(spark, sf_dir), k, doc_id="vec_id", digits=9)


_SCORES = """
WITH means AS (SELECT label AS anchor_id, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) AS e GROUP BY label, i),
anchors AS (SELECT anchor_id, list(m ORDER BY i) AS v FROM means GROUP BY anchor_id),
scores AS (SELECT e.vec_id AS id, a.anchor_id, round(list_cosine_similarity(e.embedding::DOUBLE[], a.v), 9) AS score FROM embeddings AS e CROSS JOIN anchors AS a),
ranked AS (SELECT id, anchor_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, anchor_id) AS rank FROM scores),
tops AS (SELECT id, max(CASE WHEN rank = 1 THEN anchor_id END) AS winner, max(CASE WHEN rank = 1 THEN score END) AS top1, coalesce(max(CASE WHEN rank = 2 THEN score END), 0.0) AS top2, max(CASE WHEN rank = 2 THEN anchor_id END) AS second, max(CASE WHEN rank = 3 THEN anchor_id END) AS third, max(CASE WHEN rank = 3 THEN score END) AS top3 FROM ranked GROUP BY id),
top AS (SELECT *, top1 - top2 AS margin FROM tops)
"""


def named(column: str) -> str:
    return f"CASE WHEN {column} % 2 = 0 THEN 'topic ' || {column}::VARCHAR ELSE {column}::VARCHAR END"


@query(_SCORES + "SELECT id, anchor_id, round(score, 6) AS score FROM scores")
def cosine_pairs(spark, sf_dir):
    return scores(spark, sf_dir).select("id", "anchor_id", F.round("score", 6).alias("score"))


@query(_SCORES + f"SELECT id, winner AS winner_goal_id, {named('winner')} AS winner_goal_label, round(top1, 6) AS top1, round(top2, 6) AS top2, round(margin, 6) AS margin, 'embeddings' AS source FROM top")
def top1_margin(spark, sf_dir):
    top = best(spark, sf_dir, 2)
    return assign.with_label(top.withColumnRenamed("winner", "winner_goal_id"), names(spark, sf_dir), "winner_goal_id", "anchor_id").select("id", "winner_goal_id", F.col("label").alias("winner_goal_label"), *[F.round(c, 6).alias(c) for c in ("top1", "top2", "margin")], F.lit("embeddings").alias("source"))


@query(_SCORES + "SELECT id, anchor_id, rank::INTEGER AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 3")
def ranked_anchors(spark, sf_dir):
    return assign.ranked_best(best(spark, sf_dir, 3)).withColumn("score", F.round("score", 6))


def _assigned_sql(cut: str, extra: str) -> str:
    shown = f"(top1 >= greatest(0.25, {cut}))"
    columns = ", ".join(f"CASE WHEN {shown} THEN {n}::VARCHAR END AS anchor{i}_id, CASE WHEN {shown} THEN {named(n)} END AS anchor{i}_label, CASE WHEN {shown} THEN round({s}, 6) END AS anchor{i}_score" for i, n, s in ((1, "winner", "top1"), (2, "second", "top2"), (3, "third", "top3")))
    return _SCORES + f"{extra} SELECT id, {columns}, CASE WHEN {shown} THEN 3 ELSE 0 END AS n_labels FROM top JOIN cuts USING (winner)"


@query(_assigned_sql("0.0", ", cuts AS (SELECT DISTINCT winner FROM top)"))
def anchor_topk(spark, sf_dir):
    return assign.assign_anchors(best(spark, sf_dir, 3), labels=names(spark, sf_dir), topk=3)


@query(_assigned_sql("cut", ", cuts AS (SELECT DISTINCT winner, (SELECT round(quantile_cont(top1, 0.8), 9) FROM top) AS cut FROM top)"))
def anchor_global_quantile(spark, sf_dir):
    return assign.assign_anchors(best(spark, sf_dir, 3), labels=names(spark, sf_dir), topk=3, adaptive="global-quantile")


@query(_assigned_sql("cut", ", cuts AS (SELECT winner, CASE WHEN count(*) >= 20 THEN round(quantile_cont(top1, 0.8), 9) ELSE 0.25 END AS cut FROM top GROUP BY winner)"))
def anchor_per_quantile(spark, sf_dir):
    return assign.assign_anchors(best(spark, sf_dir, 3), labels=names(spark, sf_dir), topk=3, adaptive="per-anchor-quantile")


_GOAL_CUTS = ", cuts AS (SELECT winner, CASE WHEN count(*) >= 10 THEN round(quantile_cont(top1, 0.8), 9) ELSE 0.25 END AS cut FROM top GROUP BY winner)"


def _goals_sql(accepted: str, n: str) -> str:
    cols = ", ".join(f"CASE WHEN n >= {i} THEN {a}::VARCHAR END AS goal{i}_id, CASE WHEN n >= {i} THEN {named(a)} END AS goal{i}_label, CASE WHEN n >= {i} THEN round({s}, 6) END AS goal{i}_score" for i, a, s in ((1, "winner", "top1"), (2, "second", "top2")))
    return _SCORES + f"{_GOAL_CUTS}, judged AS (SELECT *, CASE WHEN {accepted} THEN {n} ELSE 0 END AS n FROM top JOIN cuts USING (winner)) SELECT id, {cols}, n AS n_labels, round(margin, 6) AS margin FROM judged"


_BY_CUT = "top1 >= greatest(0.25, cut)"


@query(_goals_sql(_BY_CUT, "1"))
def goal_threshold(spark, sf_dir):
    return assign.classify_goals(best(spark, sf_dir, 2), labels=names(spark, sf_dir), min_margin=1.5)


@query(_goals_sql(f"{_BY_CUT} OR (margin >= 0.03 AND top1 >= 0.1)", "1"))
def goal_margin(spark, sf_dir):
    return assign.classify_goals(best(spark, sf_dir, 2), labels=names(spark, sf_dir), min_margin=0.03, margin_min_top1=0.1)


@query(_goals_sql(f"{_BY_CUT} OR margin >= 0.0", "CASE WHEN margin < 0.05 AND top1 >= 0.1 THEN 2 ELSE 1 END"))
def goal_multilabel(spark, sf_dir):
    return assign.classify_goals(best(spark, sf_dir, 2), labels=names(spark, sf_dir), multi_margin=0.05, multi_min_top1=0.1)


@query(_SCORES + f"{_GOAL_CUTS} SELECT winner::VARCHAR AS id, {named('winner')} AS label, count(*) AS n_docs FROM top JOIN cuts USING (winner) WHERE {_BY_CUT} GROUP BY winner")
def goal_summary(spark, sf_dir):
    return assign.summary(goal_threshold(spark, sf_dir), "goal")


_QUANTILES = [0, 0.05, 0.1, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1]
_FLOORS = [0.12, 0.14, 0.16, 0.18, 0.20, 0.22, 0.24, 0.26]


def _top(spark, sf_dir):
    return best(spark, sf_dir, 2)


def _sweep(spark, sf_dir):
    top = _top(spark, sf_dir).select("id", "top1", F.round("margin", 9).alias("margin"))
    return assign.coverage_sweep(top, _QUANTILES, _FLOORS)


_SWEEP = _SCORES + f""", q AS (SELECT unnest({_QUANTILES}::DOUBLE[]) AS quantile), f AS (SELECT unnest({_FLOORS}::DOUBLE[]) AS floor),
sorted AS (SELECT list(top1 ORDER BY top1) AS xs, count(*) AS n FROM top),
cuts AS (SELECT quantile, xs[floor(quantile * (n - 1))::INTEGER + 1] AS a, xs[least(floor(quantile * (n - 1))::INTEGER + 2, n)] AS b, quantile * (n - 1) - floor(quantile * (n - 1)) AS part FROM q, sorted),
grid AS (SELECT 'quantile' AS rule, quantile, floor, greatest(round(a + (b - a) * part, 9), floor) AS cut FROM cuts, f UNION ALL SELECT rule, NULL, NULL, cut FROM (VALUES ('margin>=0.03', 0.03), ('margin>=0.05', 0.05), ('margin>=0.07', 0.07)) AS m(rule, cut)),
sweep AS (SELECT rule, quantile, floor, cut, avg(CASE WHEN (rule = 'quantile' AND top1 >= cut) OR (rule <> 'quantile' AND round(margin, 9) >= cut) THEN 1.0 ELSE 0.0 END) AS coverage FROM grid CROSS JOIN top GROUP BY rule, quantile, floor, cut)
"""


@query(_SWEEP + "SELECT rule, quantile, floor, round(cut, 6) AS cut, round(coverage, 6) AS coverage FROM sweep")
def coverage_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).select("rule", "quantile", "floor", F.round("cut", 6).alias("cut"), F.round("coverage", 6).alias("coverage"))


@query(_SWEEP + "SELECT quantile, round(max(coverage), 6) AS coverage FROM sweep WHERE quantile IS NOT NULL GROUP BY quantile")
def coverage_max(spark, sf_dir):
    return assign.max_coverage(_sweep(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@query(_SCORES + ", c AS (SELECT i / 500.0 AS cut FROM range(501) AS r(i)) SELECT round(cut, 6) AS cut, round(avg(CASE WHEN top1 >= cut THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM c CROSS JOIN top GROUP BY cut")
def coverage_curve(spark, sf_dir):
    return assign.coverage_curve(_top(spark, sf_dir)).select(F.round("cut", 6).alias("cut"), F.round("coverage", 6).alias("coverage"))


def _histogram_sql(value: str, by: str = "", bins: int = 50) -> str:
    return _SCORES + f", v AS (SELECT {by or '0 AS g'}, {value} AS x FROM top), r AS (SELECT min(x) AS lo, max(x) AS hi FROM v) SELECT {'winner, ' if by else ''}least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1})::INTEGER AS bin, count(*) AS n FROM v, r GROUP BY ALL"


@query(_histogram_sql("top1"))
def score_histogram(spark, sf_dir):
    return assign.histogram(_top(spark, sf_dir), "top1")


@query(_histogram_sql("round(margin, 9)"))
def margin_histogram(spark, sf_dir):
    return assign.histogram(_top(spark, sf_dir).withColumn("margin", F.round("margin", 9)), "margin")


@query(_histogram_sql("top1", "winner"))
def score_hist_by_winner(spark, sf_dir):
    return assign.histogram(_top(spark, sf_dir), "top1", by="winner")


@query(_SCORES + ", r AS (SELECT min(top1) AS lo, max(top1) AS hi, min(round(margin, 9)) AS lo2, max(round(margin, 9)) AS hi2 FROM top) SELECT least(floor((top1 - lo) / (hi - lo) * 40), 39)::INTEGER AS bin_top1, least(floor((round(margin, 9) - lo2) / (hi2 - lo2) * 40), 39)::INTEGER AS bin_margin, count(*) AS n FROM top, r GROUP BY ALL")
def score_margin_grid(spark, sf_dir):
    return assign.grid_counts(_top(spark, sf_dir).withColumn("margin", F.round("margin", 9)), "top1", "margin")


_UNIT = """
WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS v FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM u) AS e GROUP BY label, i),
c0 AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY label),
c AS (SELECT label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS centroid FROM c0)
"""


@query(_UNIT + "SELECT label, (SELECT count(*) FROM u WHERE u.label = c.label) AS size, i::INTEGER AS i, round(x, 6) AS x FROM (SELECT label, unnest(centroid) AS x, unnest(range(len(centroid))) AS i FROM c) AS c")
def centroids(spark, sf_dir):
    rows = cluster.centroids(table(spark, sf_dir, "embeddings"), cls="label", vec="embedding")
    return rows.select(F.col("class").alias("label"), "size", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(_UNIT + ", s AS (SELECT u.label, vec_id, list_dot_product(v, centroid) AS score FROM u JOIN c USING (label)) SELECT label, arg_min(vec_id, -score) AS vec_id, round(max(score), 6) AS score FROM s GROUP BY label")
def representative_member(spark, sf_dir):
    return cluster.representatives(table(spark, sf_dir, "embeddings"), cls="label", vec="embedding", key="vec_id").select(F.col("class").alias("label"), F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query(
    _UNIT
    + """, d AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.v, b.v)) AS total, count(*) AS n FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
s AS (SELECT vec_id, max(CASE WHEN label = other THEN total / n END) AS a, min(CASE WHEN label <> other THEN total / n END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s"""
)
def silhouette_labels(spark, sf_dir):
    return cluster.silhouette(table(spark, sf_dir, "embeddings"), cls="label", vec="embedding", key="vec_id").withColumn("silhouette", F.round("silhouette", 6))


@query()
def super_anchors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    mapping = cluster.super_anchors(rows, key="vec_id", vec="embedding", k=12)
    return cluster.super_table(mapping, rows, key="vec_id", label="label", vec="embedding")


@query()
def auto_k(spark, sf_dir):
    return cluster.super_anchors(table(spark, sf_dir, "embeddings"), key="vec_id", vec="embedding", kmin=2, kmax=30)


@query()
def density_clusters(spark, sf_dir):
    return cluster.density_clusters(table(spark, sf_dir, "embeddings"), key="vec_id", vec="embedding", min_cluster_size=10)
