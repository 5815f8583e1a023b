"""Joins that Spark doesn't find by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files

#: Bytes of the tables read, a task of ``distinct``.
TASK_BYTES = 4_000_000


def distinct(df: DataFrame) -> DataFrame:
    """The distinct rows; with much input they are dealt to as many tasks as its size asks for, and kept in no table before.

    Tasks are else joined by the size of their compressed rows; long texts with much in
    common take a multiple of it, and a task's memory grew with the input.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    parts = min(-(-size // TASK_BYTES), 5000)
    if parts <= max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8):
        return df.distinct()
    return df.repartition(parts, *[F.col(f"`{c}`") for c in df.columns]).distinct()


def disjunctive_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, str]], how: str = "inner") -> DataFrame:
    """Rows of left matched with right where any (left expression = right column) holds, each pair once.

    An OR of equalities has no equi key and would become a nested-loop join.  Left rows
    are exploded to their distinct keys instead, tagged by the right column, and joined
    by equality.  A pair that matches on two columns is kept once.
    """
    left_names, right_names = left.columns, right.columns
    by_column: dict[str, list[Column]] = {}
    for expression, column in keys:
        by_column.setdefault(column, []).append(expression)
    numbered = left.withColumn("_row", F.monotonically_increasing_id())
    if how == "left":  # read twice, with the same numbers
        spark, whole = left.sparkSession, numbered
        numbered = files.built(spark, files.scratch(spark, "left"), lambda: whole)
    tagged = F.array_distinct(F.filter(F.array(*[F.struct(F.lit(c).alias("c"), e.cast("string").alias("v")) for c, es in by_column.items() for e in es]), lambda s: s["v"].isNotNull()))
    probes = numbered.select("*", (F.explode_outer if how == "left" else F.explode)(tagged).alias("_k"))
    out = None
    for column in by_column:
        side = right.select(F.struct(*right_names).alias("_r"), F.col(column).cast("string").alias("_v"))
        part = probes.where(F.col("_k.c") == column).join(side, F.col("_k.v") == F.col("_v"))
        out = part if out is None else out.unionByName(part)
    out = out.select(F.struct(*left_names).alias("_l"), "_row", "_r")
    if len(by_column) > 1:
        out = out.distinct()
    if how == "left":
        missing = numbered.join(out.select("_row").distinct(), "_row", "left_anti")
        out = out.select("_l", "_r").unionByName(missing.select(F.struct(*left_names).alias("_l"), F.lit(None).cast(out.schema["_r"].dataType).alias("_r")))
    return out.select("_l.*", *[F.col("_r").getField(c).alias(c if c not in left_names else f"right_{c}") for c in right_names])
