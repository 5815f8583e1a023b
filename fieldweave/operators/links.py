"""Link cells (JSON with ``links.from`` and ``links.to``) to columns and to one row per link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_END = "struct<id:string,type:string,typeId:string>"
_LINK = f"struct<refId:string,referenceType:string,target:{_END},source:{_END}>"
SCHEMA = f"links struct<`from`:array<{_LINK}>,`to`:array<{_LINK}>>"


def normalize_type(end: Column) -> Column:
    """Lower-case trimmed type; without one, typeId 1 is a dataset and 10 a publication; else null."""
    named = F.nullif(F.lower(F.trim(end["type"])), F.lit(""))
    number = F.trim(end["typeId"]).try_cast("int")
    return F.coalesce(named, F.when(number == 1, "dataset").when(number == 10, "publication"))


def _sides(cell: Column) -> Column:
    """All links of a cell with their direction, ``from`` before ``to``; empty for bad cells."""
    none = F.array().cast(f"array<struct<dir:string,l:{_LINK}>>")

    def tagged(parsed: Column, d: str) -> Column:
        return F.coalesce(F.transform(parsed["links"][d], lambda x: F.struct(F.lit(d).alias("dir"), x.alias("l"))), none)

    # Parsed once for both sides.
    return T.bound(lambda parsed: F.concat(tagged(parsed, "from"), tagged(parsed, "to")), F.from_json(F.coalesce(cell, F.lit("")), SCHEMA))


def _joined(values: Column, dedup: bool) -> Column:
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.array_join(F.array_distinct(kept) if dedup else kept, "; ")


def extract_links(df: DataFrame, cell: str, *, dedup: bool = False, types: bool = True, prefix: str = "links_") -> DataFrame:
    """Adds the link columns; lists aren't aligned with each other, since missing parts are skipped.

    Without ``types`` these are the four columns of the first extractor.
    """
    rows = df.withColumn("_sides", _sides(F.col(cell)))
    get = lambda f: _joined(F.transform("_sides", f), dedup)
    columns = {
        f"{prefix}dir_refids": _joined(F.transform("_sides", lambda s: F.concat(s["dir"], F.lit(" ["), s["l"]["refId"], F.lit("]"))), False),
        f"{prefix}target_ids": get(lambda s: s["l"]["target"]["id"]),
        f"{prefix}source_ids": get(lambda s: s["l"]["source"]["id"]),
        f"{prefix}reference_types": get(lambda s: F.nullif(s["l"]["referenceType"], F.lit(""))),
    }
    if types:
        columns |= {f"{prefix}target_types": get(lambda s: normalize_type(s["l"]["target"])), f"{prefix}source_types": get(lambda s: normalize_type(s["l"]["source"]))}
    return rows.withColumns(columns).drop("_sides")


def explode_links(df: DataFrame, cell: str, keep: list[str]) -> DataFrame:
    """One row per link with capitalised types, as the graph mapping expects them."""
    rows = df.select(*keep, F.explode(_sides(F.col(cell))).alias("s"))
    link = F.col("s.l")
    return rows.select(
        *keep,
        F.initcap(normalize_type(link["source"])).alias("links_source_types"),
        link["source"]["id"].alias("links_source_ids"),
        link["referenceType"].alias("links_reference_types"),
        F.initcap(normalize_type(link["target"])).alias("links_target_types"),
        link["target"]["id"].alias("links_target_ids"),
    )


def part_of(links: DataFrame, *, dataset: str, publication: str, dataset_base: str, publication_base: str, predicate: str) -> DataFrame:
    """subject, predicate, object: each distinct dataset is part of its publication; rows that lack an end give nothing."""
    rows = links.where(F.col(dataset).isNotNull() & F.col(publication).isNotNull())
    return rows.select(F.concat(F.lit(dataset_base), F.col(dataset).cast("string")).alias("subject"), F.lit(predicate).alias("predicate"), F.concat(F.lit(publication_base), F.col(publication).cast("string")).alias("object")).distinct()
