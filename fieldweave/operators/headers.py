"""Column names as data: the header simplifiers, on the driver since names are few."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hierarchy words that say nothing in a header.
HIERARCHY_WORDS = """
metadata general generaltype contacts contactstype coverage coveragetype geographiccoverage geographiccoveragetype
temporalcoverage temporalcoveragetype taxonomiccoverage methodstype methods keywordstype keywords datatypeandstatus
datatypeandstatustype repository repositorytype coordinates coordinates-wgs84 boundingbox boundingbox-wgs84 acronyms
acronymstype acronympair acronympairtype measurementstype measurements processesandservices
""".split()
_TEXT = "_#text"


def simple_header(name: str) -> str:
    """Without the text suffix, underscores as blanks, title case."""
    return name.removesuffix(_TEXT).replace("_", " ").title()


def short_header(name: str, most: int = 4) -> str:
    """The last telling words of a tree path, split at capitals, in title case."""
    fixed = {"id": "Id", "Metadata_id": "Metadata Id"}
    if name in fixed:
        return fixed[name]
    words = [re.sub(r"(?i)(type|status)$", "", w) for w in name.removesuffix(_TEXT).split("_") if w.lower() not in HIERARCHY_WORDS]
    first: dict[str, str] = {}
    for w in words:
        if w:
            first.setdefault(w.lower(), w)
    text = " ".join(list(first.values())[-most:]).replace("-", " ")
    return " ".join(re.sub(r"(?<!^)(?=[A-Z])", " ", text).split()).title()


def simple_header_column(c: Column) -> Column:
    """``simple_header`` of a column of names."""
    return title_case(F.replace(F.regexp_replace(c, f"{_TEXT}$", ""), F.lit("_"), F.lit(" ")))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small letters after, as Python's ``title`` does."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def short_header_column(c: Column, most: int = 4) -> Column:
    """``short_header`` of a column of names."""
    words = F.split(F.regexp_replace(c, f"{_TEXT}$", ""), "_")
    words = F.transform(F.filter(words, lambda w: ~F.lower(w).isin(HIERARCHY_WORDS)), lambda w: F.regexp_replace(w, "(?i)(type|status)$", ""))
    first = F.filter(words, lambda w, i: (w != "") & ~F.exists(F.slice(words, 1, i), lambda v: F.lower(v) == F.lower(w)))
    text = F.replace(F.array_join(F.slice(first, F.greatest(F.size(first) - most + 1, F.lit(1)), most), " "), F.lit("-"), F.lit(" "))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, "(?<!^)(?=[A-Z])", " "), r"\s+", " "))
    return F.when(c == "id", "Id").when(c == "Metadata_id", "Metadata Id").otherwise(title_case(spaced))


def unique(names: list[str], second: dict[str, str] | None = None) -> list[str]:
    """Names made distinct: later ones take a given other name or a number."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else (second or {}).get(n, f"{n} {seen[n]}"))
    return out


def simplify(df: DataFrame, short: bool = True) -> DataFrame:
    """df with simplified headers; a second ``Id`` is the ``Dataset Id``."""
    return df.toDF(*unique([(short_header if short else simple_header)(c) for c in df.columns], {"Id": "Dataset Id"}))


def text_columns(df: DataFrame) -> DataFrame:
    """id, Metadata_id and all text columns."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in ("id", "Metadata_id") or c.endswith(_TEXT)])


def strip_type(df: DataFrame) -> DataFrame:
    """Drop a trailing ``Type`` of column names, names kept distinct."""
    return df.toDF(*unique([c.removesuffix("Type") for c in df.columns]))
