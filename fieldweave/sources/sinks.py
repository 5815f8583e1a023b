"""Writing: CSV, JSON lines and indented JSON, N-Quads, Turtle, confusion tables and the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.mapping import n_quads, turtle


def write_csv(df: DataFrame, path: str, header: list[str] | None = None, blank: bool = False) -> None:
    """CSV with a header, in the order given; ``blank`` writes missing values and columns as empty texts."""
    names = header or df.columns
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in names] if blank else [F.col(f"`{c}`") for c in names]
    df.select(*columns).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str, nulls: bool = False) -> None:
    """One JSON object a line, non-ASCII text as it is."""
    df.write.option("ignoreNullFields", not nulls).json(path)


def write_quads(quads: DataFrame, path: str, by: str | None = None) -> None:
    """N-Quads text; ``by`` names a column whose values get a folder each."""
    if by is None:
        n_quads(quads).write.text(path)
    else:
        n_quads(quads, keep=[by]).write.partitionBy(by).text(path)


def write_pretty_json(df: DataFrame, path: str) -> None:
    """One indented JSON object a row, null fields left out, non-ASCII text as it is."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"}).alias("value")).write.text(path)


def write_turtle(quads: DataFrame, path: str, by: str | None = None) -> None:
    """Turtle text, one statement a subject; ``by`` names a column whose values get a folder each."""
    if by is None:
        turtle(quads).write.text(path)
    else:
        turtle(quads, keep=[by]).write.partitionBy(by).text(path)


def confusion_lines(table: DataFrame) -> DataFrame:
    """The lines, numbered by n, of a 2 x 2 confusion table (predicted, gold_yes, gold_no) as CSV with an empty first header."""
    rows = table.select(F.when(F.col("predicted") == "pred_yes", 1).otherwise(2).alias("n"), F.concat_ws(",", "predicted", F.col("gold_yes").cast("string"), F.col("gold_no").cast("string")).alias("value"))
    return table.sparkSession.createDataFrame([(0, '"",gold_yes,gold_no')], "n int, value string").unionByName(rows)


def write_confusion(table: DataFrame, path: str) -> None:
    """Three lines of CSV in one file."""
    confusion_lines(table).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)


def preview(df: DataFrame, n: int = 5) -> str:
    """The first n rows as text, for a console."""
    return "\n".join(["\t".join(df.columns), *["\t".join("" if v is None else str(v) for v in r) for r in df.limit(n).collect()]])


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def report(scores: DataFrame, n_ids: int) -> str:
    """A short text about an evaluation: aligned ids and the fields of each kind (one row per field is read)."""
    lines = [f"Aligned ids: {n_ids}"]
    for r in scores.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("fields")).orderBy("type").collect():
        lines.append(f"{r['type']}: {r['fields']}")
    return "\n".join(lines) + "\n"
