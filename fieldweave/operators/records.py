"""Model output: lenient JSON records to flat string tables, validation and prompts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions import text as T
from .evaluate import YESNO


def _leaf_text(v: Column) -> Column:
    """A variant as Python would print it: booleans capitalised, null empty."""
    s, kind = v.cast("string"), F.schema_of_variant(v)
    return F.when(kind == "BOOLEAN", F.initcap(s)).when(kind == "VOID", "").otherwise(F.coalesce(s, F.lit("")))


def _yes_no_one(v: Column) -> Column:
    kind, s = F.schema_of_variant(v), F.lower(T.strip(v.cast("string")))
    number = v.cast("string").try_cast("double")
    return (
        F.when(kind == "BOOLEAN", F.when(s == "true", "yes").otherwise("no"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(number != 0, "yes").otherwise("no"))
        .when(s.isin(T.YES), "yes")
        .when(s.isin(T.NO), "no")
        .otherwise("")
    )


def to_yes_no(v: Column) -> Column:
    """yes or no of any JSON value: of a list the first decisive item, else its items joined; else empty."""
    items = F.try_variant_get(v, "$", "array<variant>")
    decided = F.filter(F.transform(items, _yes_no_one), lambda x: x != "")
    return F.when(items.isNotNull(), F.coalesce(F.get(decided, F.lit(0)), F.array_join(F.transform(items, _leaf_text), "; "))).otherwise(F.coalesce(_yes_no_one(v), F.lit("")))


def to_list(v: Column) -> Column:
    """Any JSON value as trimmed strings without blanks."""
    items = F.try_variant_get(v, "$", "array<variant>")
    several = F.transform(items, lambda x: T.strip(_leaf_text(x)))
    one = F.split(F.when(F.schema_of_variant(v).startswith("STRING"), v.cast("string")).otherwise(_leaf_text(v)), rf"{T.WHITE}*[;,]{T.WHITE}*")
    return F.filter(F.coalesce(several, F.transform(one, T.strip)), lambda x: x != "")


def flat_value(v: Column, yes_no: bool) -> Column:
    """A field's cell: yes/no fields coerced, lists joined without nulls, leaves as text, null empty."""
    if yes_no:
        return to_yes_no(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    kept = F.filter(items, lambda x: F.schema_of_variant(x) != "VOID")
    return F.coalesce(F.when(items.isNotNull(), F.array_join(F.transform(kept, _leaf_text), "; ")), _leaf_text(v), F.lit(""))


def parse_records(df: DataFrame, raw: str, *, key: str = "id", error: str | None = None) -> DataFrame:
    """key, record (variant), error: bad or missing JSON keeps its row with a message."""
    text = T.lenient_json(F.col(raw))
    record = F.try_parse_json(text)
    given = F.col(error).cast("string") if error else F.lit(None).cast("string")
    ok = record.isNotNull() & F.schema_of_variant(record).startswith("OBJECT")
    return df.select(key, F.when(ok, record).alias("record"), F.coalesce(given, F.when(F.col(raw).isNull(), "missing raw").when(~F.coalesce(ok, F.lit(False)), "not a JSON object")).alias("error"))


def record_keys(records: DataFrame) -> list[str]:
    """The distinct keys of all records in order of name; bounded by the schema of the model, not by rows."""
    return sorted(r[0] for r in records.where("record is not null").select(F.explode(F.map_keys(F.try_variant_get("record", "$", "map<string,variant>"))).alias("k")).distinct().collect())


def flatten_records(records: DataFrame, keys: list[str], *, key: str = "id", yes_no: list[str] = YESNO) -> DataFrame:
    """key, one string column per key, error; missing values are empty."""
    cells = [F.coalesce(flat_value(F.try_variant_get("record", f"$['{k}']", "variant"), k in yes_no), F.lit("")).alias(k) for k in keys]
    return records.select(key, *cells, F.coalesce("error", F.lit("")).alias("error"))


def build_schema(catalogue: DataFrame, title: str, *, name: str = "category name", definition: str = "category definition", allowed: str = "allowed answers") -> dict:
    """A JSON schema of a category table (a few dozen rows, read on the driver)."""
    missing = {name, definition, allowed} - set(catalogue.columns)
    if missing:
        raise ValueError(f"the catalogue lacks {sorted(missing)}")
    rows = catalogue.select(F.trim(F.col(f"`{name}`").cast("string")).alias("name"), T.normalize_key(F.col(f"`{name}`").cast("string")).alias("key"), F.trim(F.coalesce(F.col(f"`{definition}`").cast("string"), F.lit(""))).alias("definition"), T.allowed_answers(F.col(f"`{allowed}`").cast("string")).alias("a"))
    properties = {}
    for r in rows.toLocalIterator():
        if r["a"]["type"] == "integer":
            spec = {"type": "integer", "description": r["definition"]}
        else:
            items = {"type": "string", **({"enum": list(r["a"]["enum"])} if r["a"]["enum"] else {})}
            spec = {"type": "array", "items": items, "uniqueItems": False, "description": r["definition"]}
        properties[r["key"]] = {**spec, "x_original_name": r["name"]}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": title, "type": "object", "additionalProperties": False, "properties": properties}


def prompts(df: DataFrame, schema: dict, *, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """df with system_prompt (the same for all rows) and user_prompt."""
    properties = schema.get("properties", {})
    enums = {k: v.get("items", v).get("enum") for k, v in properties.items()}
    enum_block = "\n".join(f"- {k}: {', '.join(map(str, e))}" for k, e in enums.items() if e) or "(none)"
    texts = {k: v.get("description") or v.get("x_original_name") or "" for k, v in properties.items()}
    define_block = "\n".join(f"- {k}: {t}" for k, t in texts.items() if t) or "(none)"
    system = f"Extract metadata as one JSON object.\nKEYS: {', '.join(properties)}\nALLOWED VALUES:\n{enum_block}\nDEFINITIONS:\n{define_block}\nReturn only the JSON object."
    user = F.concat(F.lit("TITLE:\n"), F.coalesce(F.col(title), F.lit("")), F.lit("\n\nABSTRACT:\n"), F.coalesce(F.col(abstract), F.lit("")), F.lit("\n\nNow produce ONLY the JSON object with fields as per the schema keys above."))
    return df.withColumn("system_prompt", F.lit(system)).withColumn("user_prompt", user)


def validate(df: DataFrame, raw: str, schema: dict, *, key: str = "id") -> DataFrame:
    """key, valid, errors, prediction (JSON text, null with any error), raw (null when valid).

    Scalars of list fields become lists, null an empty one; allowed values take their
    listed spelling, and items that aren't strings are dropped there.  What is left is
    checked for types, allowed values and unknown keys.
    """
    properties = schema.get("properties", {})
    text = T.strip(F.regexp_replace(F.regexp_replace(T.strip(F.col(raw)), rf"(?i)^```json{T.WHITE}*", ""), rf"{T.WHITE}*```$", ""))
    record = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))
    errors, fields = [F.when(~is_object, F.lit("JSON parse error"))], []
    for name, spec in properties.items():
        v = F.try_variant_get(record, f"$['{name}']", "variant")
        kind = F.schema_of_variant(v)
        if spec["type"] == "integer":
            whole = kind.rlike("^BIGINT") | (v.cast("string").try_cast("double") == F.floor(v.cast("string").try_cast("double"))) & kind.rlike("^(DECIMAL|DOUBLE)")
            errors.append(F.when(v.isNotNull() & ~F.coalesce(whole, F.lit(False)), F.lit(f"['{name}']: not of type 'integer'")))
            fields.append((name, F.when(v.isNotNull(), v.cast("string"))))
            continue
        items = F.try_variant_get(v, "$", "array<variant>")
        items = F.when(kind == "VOID", F.array().cast("array<variant>")).when(kind.startswith("STRING"), F.array(v)).otherwise(items)
        errors.append(F.when(v.isNotNull() & items.isNull(), F.lit(f"['{name}']: not of type 'array'")))
        is_string = lambda x: F.schema_of_variant(x).startswith("STRING")
        allowed = spec["items"].get("enum")
        if allowed:
            spelling = F.create_map(*[F.lit(x) for e in reversed(allowed) for x in (e.lower(), e)]) if len({e.lower() for e in allowed}) == len(allowed) else F.map_from_arrays(F.array(*[F.lit(x) for x in dict.fromkeys(e.lower() for e in allowed)]), F.array(*[F.lit(next(e for e in allowed if e.lower() == x)) for x in dict.fromkeys(e.lower() for e in allowed)]))
            strings = F.transform(F.filter(items, is_string), lambda x: F.coalesce(F.try_element_at(spelling, F.lower(x.cast("string"))), x.cast("string")))
            errors.append(F.when(F.exists(strings, lambda x: ~x.isin(allowed)), F.lit(f"['{name}']: a value that is not allowed")))
        else:
            strings = F.transform(items, lambda x: x.cast("string"))
            errors.append(F.when(F.exists(items, lambda x: ~is_string(x)), F.lit(f"['{name}']: an item that is not a string")))
        fields.append((name, F.when(v.isNotNull(), F.to_json(strings))))
    extra = F.filter(F.map_keys(F.try_variant_get(record, "$", "map<string,variant>")), lambda k: ~k.isin(list(properties)) if properties else F.lit(True))
    errors.append(F.when(F.size(extra) > 0, F.concat(F.lit("unexpected keys: "), F.array_join(extra, ", "))))
    found = F.filter(F.array(*errors), lambda e: e.isNotNull())
    parts = F.filter(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(json.dumps(n) + ": "), v)) for n, v in fields]), lambda p: p.isNotNull())
    body = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    return df.select(key, F.col(raw).alias("raw"), found.alias("errors"), body.alias("prediction")).select(key, (F.size("errors") == 0).alias("valid"), "errors", F.when(F.size("errors") == 0, F.col("prediction")).alias("prediction"), F.when(F.size("errors") > 0, F.col("raw")).alias("raw"))


def infer(df: DataFrame, call: Callable[[str, str], str], *, key: str = "id", system: str = "system_prompt", user: str = "user_prompt", attempts: int = 1) -> DataFrame:
    """key, raw, error: a model called once a row inside the executors; a failed row keeps its error."""

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            raws, errors = [], []
            for s, u in zip(pdf[system], pdf[user], strict=True):
                raw = error = None
                for _ in range(max(attempts, 1)):
                    try:
                        raw, error = call(s, u), None
                        break
                    except Exception as e:  # the row's own failure, reported with it
                        error = f"{type(e).__name__}: {e}"
                raws.append(raw)
                errors.append(error)
            yield pd.DataFrame({key: pdf[key], "raw": raws, "error": errors})

    schema = ty.StructType([df.schema[key], ty.StructField("raw", ty.StringType()), ty.StructField("error", ty.StringType())])
    return df.select(key, system, user).mapInPandas(run, schema)


def embed(df: DataFrame, call: Callable[[list[str]], list[list[float]]], *, key: str = "id", text: str = "text", batch: int = 64, attempts: int = 6, wait: float = 0.0, doubling: bool = False) -> DataFrame:
    """key, embedding: texts sent in batches to an embedding callable.

    A batch that fails is tried again after a wait, which grows by itself each time or doubles;
    after the last attempt the job fails.
    """

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                for done in range(1, attempts + 1):
                    try:
                        vectors = call([t or "" for t in part[text]])
                        break
                    except Exception:
                        if done == attempts:
                            raise
                        time.sleep(wait * (2 ** (done - 1) if doubling else done))
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [list(map(float, v)) for v in vectors]})

    schema = ty.StructType([df.schema[key], ty.StructField("embedding", ty.ArrayType(ty.FloatType()))])
    return df.select(key, text).mapInPandas(run, schema)


def counted(validated: DataFrame) -> DataFrame:
    """n_valid, n_total."""
    return validated.agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n_total"))
