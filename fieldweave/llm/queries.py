"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, decontaminate, kd_shards, licenses, near_dedup, packing, quality, suffix_dedup, token_files, url_filters
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("threshold")


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.kd_shards(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(_table(spark, sf_dir, "documents"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("source", "ids")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and domains of the pages, fixed by digests of their names."""

    def digit(column: str, at: int):
        return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col(column).cast("binary")), at, 1)) - 1

    hosts = pages.select(url_filters.host_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct().withColumn("kind", F.lit("host")).withColumn("category", F.lit("spam"))
    domains = hosts.select(F.array_join(F.slice(F.split("pattern", r"\."), -2, 2), ".").alias("pattern")).where(F.size(F.split("pattern", r"\.")) == 2).distinct().withColumn("kind", F.lit("domain")).withColumn("category", F.lit("tracker"))
    named = hosts.unionByName(domains).withColumn("a", digit("pattern", 1)).withColumn("b", digit("pattern", 2))
    steps = F.filter(
        F.array(
            F.struct(F.lit("add").alias("action"), (F.col("b") * 7).alias("day"), F.lit(12).alias("below")),
            F.struct(F.lit("remove").alias("action"), (F.col("b") * 7 + 90).alias("day"), F.lit(8).alias("below")),
            F.struct(F.lit("add").alias("action"), (F.col("b") * 7 + 150).alias("day"), F.lit(4).alias("below")),
        ),
        lambda s: F.col("a") < s["below"],
    )
    return named.select("kind", "pattern", "category", F.inline(steps)).select("kind", "pattern", "category", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int")).alias("at"), "action")


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")))
    return url_filters.filter_urls(captures, list_changes(pages))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_kd_sharding": op3_kd_sharding,
    "op4_token_files": op4_token_files,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_url_lists": op9_url_lists,
    "op10_minhash": op10_minhash,
}

__all__ = ["ORACLES", "QUERIES"]
