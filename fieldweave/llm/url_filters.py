"""Temporal list join: captures against the list entries in force when they were fetched.

A list is a log of dated changes (add or remove) of patterns: a host (``host``), a
domain with all its subdomains (``domain``).  The changes of one pattern become
validity intervals, from each addition to the next change.  Every capture is joined,
as of its fetch time, with the entries of its host and of each parent domain.

Defined results: a null or hostless URL and a null fetch time match nothing; entries
with null fields are left out; of several changes of a pattern at one time the removal
wins; equal intervals collapse; repeated captures are each judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals broadcast at most; a longer list is joined by shuffle, with hot hosts salted.
BROADCAST_ROWS = 100_000
#: Parts of each key on the shuffle path.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def intervals(changes: DataFrame) -> DataFrame:
    """kind, pattern, category, valid_from, valid_to (null: open) from changes (kind, pattern, category, at, action)."""
    known = changes.select("kind", F.lower("pattern").alias("pattern"), "category", "at", "action").dropna()
    by_time = known.groupBy("kind", "pattern", "category", "at").agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
    order = Window.partitionBy("kind", "pattern", "category").orderBy("at")
    return by_time.withColumn("valid_to", F.lead("at").over(order)).where("removed = 0").select("kind", "pattern", "category", F.col("at").alias("valid_from"), "valid_to")


def matches(captures: DataFrame, changes: DataFrame, *, key: str, url: str, fetched: str) -> DataFrame:
    """key, fetched, host, kind, pattern, category of every entry in force for a capture."""
    spans = intervals(changes)
    small = spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = captures.select(F.col(key).alias("__key"), F.col(fetched).alias("__at"), host_of(F.col(url)).alias("host")).where(F.col("host").isNotNull() & F.col("__at").isNotNull())
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    keys = F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"))), parents)
    keyed = rows.select("__key", "__at", "host", F.inline(keys))
    on = ["kind", "pattern"]
    if small:
        joined = keyed.join(F.broadcast(spans), on)
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("__key", "__at"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"])
    return joined.where((F.col("valid_from") <= F.col("__at")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to"))))


def filter_urls(captures: DataFrame, changes: DataFrame, *, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """key, fetched, host, categories (distinct, sorted, comma-joined), n_entries and blocked of every capture."""
    found = matches(captures, changes, key=key, url=url, fetched=fetched).groupBy("__key", "__at", "host").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.countDistinct("kind", "pattern", "category").alias("n_entries"))
    rows = captures.select(F.col(key), F.col(fetched), host_of(F.col(url)).alias("host"))
    joined = rows.join(found.withColumnRenamed("host", "__host"), (rows[key].eqNullSafe(F.col("__key"))) & (rows[fetched] == F.col("__at")) & (rows["host"] == F.col("__host")), "left")
    return joined.select(key, fetched, "host", F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.col("n_entries").isNotNull().alias("blocked"))
