"""K-d tree sharding: recursive splits at distributed weighted medians.

Every document is a point over its metadata dimensions.  A node that still holds more
than one shard is split along the dimension in which its points spread widest (of the
whole table's spread), where the bytes on the left reach the left side's part of the
shards.  Texts count by the bytes of all smaller values, so whole strings are ordered,
however much they have in common.  Ties in a dimension are ordered by a hash of the row, so
a split can fall inside any group of equal values, equal texts included.  Medians are found
by histograms of at most ``BINS`` cells a node, zoomed in until the split cell holds under
``TOLERANCE`` of a shard; the cell is picked inside Spark, and one row a node reaches the
driver, which is bounded by the number of shards.

Defined results: null metadata counts as the lowest value; a null text has no bytes;
repeated rows are points of their own; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

BINS = 2048
TOLERANCE = 1e-3
#: Bytes counted for a row besides its text.
ROW_BYTES = 16
#: Rows numbered together when slots are given.
SLOT_ROWS = 50_000
#: Rows of a table about nodes that are broadcast at most.
BROADCAST_NODES = 500_000
#: Levels of the tree after which the points are written, to keep plans short.
WRITE_LEVELS = 4
_HALF = 31
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _number(column: str) -> Column:
    """Numbers by their logarithm, either side of 0."""
    x = F.col(column).cast("double")
    return F.signum(x) * F.log2(1 + F.abs(x))


def _text_places(points: DataFrame, column: str) -> DataFrame:
    """value, place: the bytes of all smaller values, for each distinct text of a column."""
    sums = points.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.sum("size").alias("w"))
    parts = written(sums.repartitionByRange(F.col("value")).withColumn("part", F.spark_partition_id()), "kd-values")
    ahead = lambda w: F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.groupBy("part").agg(F.sum("w").alias("w")).select("part", ahead(Window.orderBy("part")).alias("before"))
    inside = parts.select("part", "value", ahead(Window.partitionBy("part").orderBy("value")).alias("inside"))
    return inside.join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("inside")).cast("double").alias("place"))


def _node_table(points: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    table = points.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_NODES else table


def _grow(points: DataFrame, shards: int, dims: int, tolerance: float) -> DataFrame:
    """points (size, c0, c1, ...) with shard: nodes of more than one shard are split, level by level."""
    points = points.withColumn("node", F.lit(1 if shards > 1 else -1).cast("long"))
    todo = {1: (0, shards)} if shards > 1 else {}
    value = F.element_at(F.array(*[F.col(f"c{d}") for d in range(dims)]), F.col("dim") + 1)
    level = 0
    while todo:
        active = points.where("node > 0")
        found = active.groupBy("node").agg(F.sum("size").alias("w"), *[f(f"c{d}").alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        search, unit, dim, cuts = {}, {}, {}, {}
        for r in found:
            node, (_, n) = r["node"], todo[r["node"]]
            dim[node] = max(range(dims), key=lambda d, r=r: ((r[f"hi{d}"] >> _HALF) - (r[f"lo{d}"] >> _HALF), -d))
            search[node] = (r[f"lo{dim[node]}"], r[f"hi{dim[node]}"], r["w"] * (n // 2) / n)
            unit[node] = r["w"] / n
        while search:
            table = _node_table(points, [(n, dim[n], lo, hi, (hi - lo) // BINS + 1, target) for n, (lo, hi, target) in search.items()], "node long, dim int, lo long, hi long, step long, target double")
            cells = active.join(table, "node").withColumn("v", value).where("v between lo and hi")
            cells = cells.groupBy("node", "target", F.expr("(v - lo) div step").alias("cell")).agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            ahead = Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
            picked = cells.withColumn("before", F.coalesce(F.sum("w").over(ahead), F.lit(0))).where("before < target and before + w >= target")
            for r in picked.collect():
                left = r["target"] - r["before"]
                if r["w"] <= tolerance * unit[r["node"]] or r["lo"] == r["hi"]:
                    cuts[r["node"]] = r["lo"] if left < r["w"] / 2 else r["hi"] + 1
                    del search[r["node"]]
                else:
                    search[r["node"]] = (r["lo"], r["hi"], left)
        below, rows = {}, []
        for node, cut in cuts.items():
            first, n = todo[node]
            sides = []
            for number, at, size in ((2 * node, first, n // 2), (2 * node + 1, first + n // 2, n - n // 2)):
                if size > 1:
                    below[number] = (at, size)
                sides.append(number if size > 1 else -1 - at)
            rows.append((node, dim[node], cut, *sides))
        if rows:
            moved = points.join(_node_table(points, rows, "node long, dim int, cut long, low long, high long"), "node", "left")
            points = moved.withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).when(value < F.col("cut"), F.col("low")).otherwise(F.col("high"))).drop("dim", "cut", "low", "high")
        todo, level = below, level + 1
        if level % WRITE_LEVELS == 0 and todo:
            points = written(points, "kd-points")
    return points.withColumn("shard", (-1 - F.col("node")).cast("int")).drop("node")


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source", "n_chars"), tolerance: float = TOLERANCE) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row; ``target_bytes`` sets the number of shards where it isn't given."""
    kinds = dict(docs.dtypes)
    dims = tuple(d for d in dims if d in kinds)
    numeric = [kinds[d].split("(")[0] in _NUMBERS for d in dims]
    light = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32"),
        *[(_number(d) if number else F.col(d).cast("string")).alias(f"d{i}") for i, (d, number) in enumerate(zip(dims, numeric, strict=True))],
    )
    light = written(light, "kd-points")
    again = not light.groupBy("key", "size", "text_crc32").count().where("count > 1").isEmpty()
    light = light.withColumn("tie", F.shiftrightunsigned(F.xxhash64("key", "size", "text_crc32", *([F.monotonically_increasing_id()] if again else [])), 64 - _HALF))
    for i, number in enumerate(numeric):
        if not number:
            places = _text_places(light, f"d{i}")
            light = light.join(places, light[f"d{i}"] == places["value"], "left").drop("value", f"d{i}").withColumnRenamed("place", f"d{i}")
    n = max(1, len(dims))
    edges = light.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *[f(f"d{i}").alias(f"{name}{i}") for i in range(len(dims)) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if shards is None:
        shards = max(1, -(-int(edges["w"] or 0) // int(target_bytes or 1 << 30)))
    coords = []
    for i in range(n):
        if dims and edges[f"lo{i}"] is not None and edges[f"hi{i}"] > edges[f"lo{i}"]:
            scaled = F.floor((F.col(f"d{i}") - edges[f"lo{i}"]) / (edges[f"hi{i}"] - edges[f"lo{i}"]) * (2**_HALF - 2)).cast("long") + 1
            scaled = F.coalesce(scaled, F.lit(0).cast("long"))
        else:
            scaled = F.when(F.col(f"d{i}").isNull(), 0).otherwise(1).cast("long") if dims else F.lit(0).cast("long")
        coords.append((F.shiftleft(scaled, _HALF) + F.col("tie")).alias(f"c{i}"))
    points = written(light.select("key", "size", "text_crc32", *coords), "kd-coordinates")
    placed = _grow(points, shards, n, tolerance).select("key", "size", "text_crc32", "shard")
    parts = max(1, -(-int(edges["n"] or 0) // SLOT_ROWS))
    placed = written(placed.withColumn("part", F.pmod(F.xxhash64("key", "text_crc32", "size", F.monotonically_increasing_id()), F.lit(parts))), "kd-placed")
    counts = placed.groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    numbered = placed.withColumn("inside", F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "text_crc32", "size")) - 1)
    return numbered.join(before, ["shard", "part"]).select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, *, key: str = "doc_id") -> None:
    """Write the documents to one folder a shard; keys must be distinct."""
    docs.join(assigned.select(key, "shard"), key).write.partitionBy("shard").parquet(path)
