"""Whole runs: the steps that the engine's users chain, with models passed in as callables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stopwords
from ..operators import assign, cluster, ctfidf, evaluate, records
from ..sources import files

Embed = Callable[[list[str]], list[list[float]]]
Ask = Callable[[str, str], str]


def embedded(spark: SparkSession, docs: DataFrame, embed: Embed, name: str) -> DataFrame:
    """id, text, source, embedding of documents (id, text, source); vectors are written, so a model is asked once."""
    vectors = files.built(spark, files.scratch(spark, name), lambda: records.embed(docs, embed))
    return docs.join(vectors, "id")


def topics_of(docs: DataFrame, cls: str, **options) -> tuple[DataFrame, DataFrame]:
    """(topic table, ranked terms) of documents (id, text) with a class column."""
    terms = ctfidf.class_tfidf(docs, cls=cls, text="text", order="id", **options)
    return ctfidf.topic_table(docs, terms, cls=cls), terms


def embed_and_cluster(spark: SparkSession, docs: DataFrame, embed: Embed, *, min_cluster_size: int = 20, **options) -> dict[str, DataFrame]:
    """Documents to vectors to density clusters to topics: clusters, topics, terms, counts."""
    rows = embedded(spark, docs, embed, "vectors")
    found = cluster.density_clusters(rows, key="id", vec="embedding", min_cluster_size=min_cluster_size)
    clusters = files.built(spark, files.scratch(spark, "clusters"), lambda: found.withColumnRenamed("key", "id"))
    inside = docs.join(clusters.where(~F.col("is_outlier")), "id")
    topics, terms = topics_of(inside, "cluster_id", **options)
    return {"clusters": clusters, "topics": topics, "terms": terms, "counts": cluster.outliers(clusters)}


def embed_cluster_refine(spark: SparkSession, docs: DataFrame, embed: Embed, ask: Ask | None = None, *, min_cluster_size: int = 20, **options) -> dict[str, DataFrame]:
    """The same with a keyword and a sentence for each topic, a model's where it answers."""
    out = embed_and_cluster(spark, docs, embed, min_cluster_size=min_cluster_size, **options)
    stop = stopwords.union(extra=",".join(stopwords.REFINER_EXTRA), domain=[])
    refined = ctfidf.refine(out["topics"], ctfidf.keyword(out["terms"], stop))
    return out | {"refined": refine_with(refined, out["topics"], ask) if ask else refined}


def refine_with(refined: DataFrame, topics: DataFrame, ask: Ask) -> DataFrame:
    """Heuristic keywords and sentences replaced by a model's answers; a failed call keeps the heuristic."""
    prompts = ctfidf.refine_prompts(topics)
    rows = prompts.select("class", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_prompt").alias("user_prompt")) for k in ("keyword", "sentence")])))
    keyed = rows.select(F.to_json(F.struct("class", "kind")).alias("key"), "class", "kind", F.lit("You label topics.").alias("system_prompt"), "user_prompt")
    answers = keyed.join(records.infer(keyed, ask, key="key"), "key").groupBy("class").agg(*[F.max(F.when(F.col("kind") == k, F.col("raw"))).alias(f"{k}_raw") for k in ("keyword", "sentence")])
    return ctfidf.refined_by_model(refined, answers)


def embed_and_assign(spark: SparkSession, docs: DataFrame, anchors: DataFrame, embed: Embed, *, topk: int = 1, threshold: float = 0.25, adaptive: str = "none", quantile: float = 0.80, min_support: int = 20) -> dict[str, DataFrame]:
    """Documents and anchors (id, label, text) to vectors, each document to its best anchors, with topics of the accepted ones."""
    rows = embedded(spark, docs, embed, "vectors")
    known = embedded(spark, anchors.withColumn("source", F.lit("anchors")), embed, "anchor-vectors")
    top = assign.best_anchors(rows, known, topk, anchor_id="id")
    assigned = assign.assign_anchors(top, labels=anchors.select(F.col("id").alias("anchor_id"), "label"), topk=topk, threshold=threshold, adaptive=adaptive, quantile=quantile, min_support=min_support)
    inside = docs.join(assigned.where(F.col("anchor1_id").isNotNull()).select("id", "anchor1_id"), "id")
    topics, terms = topics_of(inside, "anchor1_id", pattern=ctfidf.PATTERN_ANCHOR, stop=stopwords.union())
    return {"assigned": assigned, "summary": assign.summary(assigned, "anchor"), "topics": topics, "terms": terms}


def embed_and_assign_adaptive(spark: SparkSession, docs: DataFrame, anchors: DataFrame, embed: Embed, **options) -> dict[str, DataFrame]:
    """The same with a cut for each anchor: its 0.80 quantile, 0.25 at least."""
    return embed_and_assign(spark, docs, anchors, embed, **({"adaptive": "per-anchor-quantile"} | options))


def super_anchor_run(spark: SparkSession, docs: DataFrame, anchors: DataFrame, embed: Embed, *, k: int = 0, kmin: int = 25, kmax: int = 60, threshold: float = 0.25) -> dict[str, DataFrame]:
    """Anchors to super anchors, documents to the super anchors' centroids."""
    known = embedded(spark, anchors.withColumn("source", F.lit("anchors")), embed, "anchor-vectors")
    mapping = files.built(spark, files.scratch(spark, "super-anchors"), lambda: cluster.super_anchors(known, key="id", vec="embedding", k=k, kmin=kmin, kmax=kmax))
    table = cluster.super_table(mapping, known, key="id", label="label", vec="embedding")
    centres = cluster.centroids(known.join(mapping.withColumnRenamed("key", "id"), "id"), cls="super_id", vec="embedding")
    top = assign.best_anchors(embedded(spark, docs, embed, "vectors"), centres, 1, anchor_id="class", anchor_vec="centroid")
    labels = table.select(F.col("super_id").alias("anchor_id"), F.col("repr_label").cast("string").alias("label"))
    return {"mapping": mapping, "table": table, "assigned": assign.assign_anchors(top, labels=labels, threshold=threshold)}


def classify(spark: SparkSession, docs: DataFrame, goals: DataFrame, embed: Embed, **options) -> dict[str, DataFrame]:
    """Goals (id, label, text) and documents to vectors, documents to goals."""
    rows = embedded(spark, docs, embed, "vectors")
    known = embedded(spark, goals.withColumn("source", F.lit("goals")), embed, "goal-vectors")
    top = assign.best_anchors(rows, known, max(options.get("topk", 1), options.get("max_multi", 2), 2), anchor_id="id")
    found = assign.classify_goals(top, labels=goals.select(F.col("id").alias("anchor_id"), "label"), **options)
    return {"classified": found, "summary": assign.summary(found, "goal"), "scores": top}


def extract_and_evaluate(spark: SparkSession, publications: DataFrame, catalogue: DataFrame, ask: Ask, gold: DataFrame | None = None, *, limit: int | None = None) -> dict[str, DataFrame]:
    """Publications (id, title, abstract) to prompts, a model's answers, validated and flat records, and their scores against gold."""
    schema = records.build_schema(catalogue, "metadata")
    rows = files.first_rows(publications, limit) if limit else publications
    asked = records.prompts(rows, schema)
    raw = files.built(spark, files.scratch(spark, "answers"), lambda: records.infer(asked, ask))
    parsed = records.parse_records(raw, "raw", error="error")
    flat = records.flatten_records(parsed, list(schema["properties"]))
    checked = records.validate(raw, "raw", schema)
    out = {"raw": raw, "flat": flat, "validated": checked, "counts": records.counted(checked)}
    return out | ({"scores": evaluate.evaluate(flat.drop("error"), gold)} if gold is not None else {})
