"""Nested JSON and XML records as relations and as triples."""

from __future__ import annotations

import json as json_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _leaf(v) -> str | None:
    """A leaf's text: booleans in lower case, null as null."""
    return None if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else str(v)


def _nodes(text: str | None, depth: int | None):
    """Yield (path, parent, key, pos, kind, value) of every node below the root, without recursion; nothing for bad JSON."""
    try:
        root = json_module.loads(text or "", parse_constant=_refused)
    except ValueError:
        return
    open_ = [((), root)]
    while open_:
        parent, node = open_.pop()
        if depth is not None and len(parent) >= depth:
            continue
        items = [(k, i, node[k]) for i, k in enumerate(sorted(node))] if isinstance(node, dict) else [(None, i, v) for i, v in enumerate(node)] if isinstance(node, list) else []
        for key, pos, v in items:
            path = (*parent, str(pos) if key is None else key)
            kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "leaf"
            yield path, parent, key, pos, kind, _leaf(v) if kind == "leaf" else None
            if kind != "leaf":
                open_.append((path, v))


def _refused(name: str):
    raise ValueError(name)


def walk(df: DataFrame, json: str, keep: list[str], depth: int | None = None) -> DataFrame:
    """One row per node below the root of each JSON tree: keep, path (array), parent (array), key, pos, kind, value (text of leaves).

    Fields of an object are numbered by name.  A tree is walked where its row is, in one pass,
    to its end or to ``depth`` levels; level by level in SQL every level would scan the rows again.
    """
    import pyarrow as pa

    kept = [df.schema[k] for k in keep]
    schema = ty.StructType([*kept, *ty.StructType.fromDDL("path array<string>, parent array<string>, key string, pos int, kind string, value string").fields])
    kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = [*keep, "path", "parent", "key", "pos", "kind", "value"]
    body = len(keep)

    def run(batches):
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(body)):
                for node in _nodes(text.as_py(), depth):
                    rows.append(node)
                    at.append(i)
                if len(rows) >= 20_000 or i == batch.num_rows - 1:
                    columns = list(zip(*rows, strict=True)) or [()] * 6
                    take = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[batch.column(j).take(take) for j in range(body)], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)
                    rows, at = [], []

    return df.select(*keep, F.col(json).cast("string").alias("_json")).mapInArrow(run, schema)


def path_text(path: Column, separator: str = "/") -> Column:
    """A path as text, blanks as ``_``."""
    return F.replace(F.array_join(path, separator), F.lit(" "), F.lit("_"))


def shallow_triples(df: DataFrame, json: str, *, key: str, base: str) -> DataFrame:
    """subject, predicate, object of one level: a list gives one triple an item, an object ``key_subkey``, a leaf itself; rows without a key are skipped."""
    tree = walk(df.where(F.col(key).isNotNull()), json, [key], depth=2)
    subject = F.concat(F.lit(base), F.col(key).cast("string"))
    top = tree.where((F.size("path") == 1) & (F.col("kind") == "leaf") & F.col("value").isNotNull()).select(subject.alias("subject"), F.col("key").alias("predicate"), F.col("value").alias("object"))
    inner = tree.where((F.size("path") == 2) & F.col("value").isNotNull())
    name = F.when(F.col("key").isNotNull(), F.concat(F.get("path", F.lit(0)), F.lit("_"), F.col("key"))).otherwise(F.get("path", F.lit(0)))
    return top.unionByName(inner.select(subject.alias("subject"), name.alias("predicate"), F.col("value").alias("object"))).distinct()


def deep_triples(df: DataFrame, json: str, *, key: str, base: str, predicate_base: str = "") -> DataFrame:
    """subject, predicate, object, object_kind of a whole tree.

    A container's IRI is its path below the record.  A field bears its own key; an item of
    a list is an IRI linked by the last part of the list's path.  Null fields give nothing.
    """
    tree = walk(df.where(F.col(key).isNotNull()), json, [key])
    record = F.col(key).cast("string")
    iri = lambda p: F.concat(F.lit(base), path_text(F.concat(F.array(record), p)))
    literal = F.col("key").isNotNull() & (F.col("kind") == "leaf")
    name = F.coalesce("key", F.element_at(F.concat(F.array(record), F.col("parent")), -1))
    rows = tree.where(~literal | F.col("value").isNotNull())
    return rows.select(iri(F.col("parent")).alias("subject"), F.concat(F.lit(predicate_base), name).alias("predicate"), F.when(literal, F.col("value")).otherwise(iri(F.col("path"))).alias("object"), F.when(literal, "literal").otherwise("iri").alias("object_kind")).distinct()


def entry_graph(df: DataFrame, json: str, *, key: str, base: str, predicate_base: str, root_type: str) -> DataFrame:
    """entry and the quads (graph, subject, predicate, object, object_kind, lang, datatype) of every record's own graph: its root's type and its tree."""
    kept = df.where(F.col(key).isNotNull())
    record = F.col(key).cast("string")
    roots = kept.select(record.alias("entry"), F.concat(F.lit(base), path_text(F.array(record))).alias("subject"), F.lit(RDF_TYPE).alias("predicate"), F.lit(root_type).alias("object"), F.lit("iri").alias("object_kind")).distinct()
    tree = deep_triples(kept, json, key=key, base=base, predicate_base=predicate_base)
    entry = F.regexp_extract(F.substring("subject", len(base) + 1, 1 << 20), "^([^/]*)", 1)
    all_ = roots.unionByName(tree.select(entry.alias("entry"), "subject", "predicate", "object", "object_kind"))
    return all_.select("entry", F.lit("").alias("graph"), "subject", "predicate", "object", "object_kind", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))


def flatten_columns(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs as columns joined by a separator, a leading ``@`` or ``_`` of attributes dropped; arrays stay."""
    found: list[tuple[Column, str]] = []

    def visit(schema: ty.StructType, at: list[str]) -> None:
        for f in schema.fields:
            path = [*at, f.name]
            if isinstance(f.dataType, ty.StructType):
                visit(f.dataType, path)
            else:
                found.append((F.col(".".join(f"`{p}`" for p in path)), separator.join(p.lstrip("@") for p in path)))

    visit(df.schema, [])
    return df.select(*[c.alias(n) for c, n in found])


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """XML rows by tag; attributes come as ``_name``, text as ``_VALUE``.  A schema with arrays takes single elements and lists alike."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def _named(element: str):
    """Yield (name, text) of each element with a ``name`` attribute and text of its own, in document order; nothing for bad XML."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(element)
    except ElementTree.ParseError:
        return
    for e in root.iter():
        own = "".join([e.text or "", *[c.tail or "" for c in e]])
        if e.get("name") is not None and own.strip():
            yield e.get("name"), own.strip()


def xml_records(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """keep, pos, name, value of every element with a ``name`` attribute and text of its own, anywhere in an XML text column.

    Texts before, between and after an element's children are one value.  SQL's XPath gives
    names and texts as two lists, which don't pair up in mixed content, so elements are walked.
    """
    import pyarrow as pa

    schema = ty.StructType([*[df.schema[k] for k in keep], *ty.StructType.fromDDL("pos int, name string, value string").fields])
    body = len(keep)

    def run(batches):
        for batch in batches:
            rows = [(i, n, *pair) for i, text in enumerate(batch.column(body).to_pylist()) if text for n, pair in enumerate(_named(text))]
            at, pos, names, values = list(zip(*rows, strict=True)) or [()] * 4
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(take) for j in range(body)], pa.array(pos, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())], names=[*keep, "pos", "name", "value"])

    return df.select(*keep, F.col(xml).alias("_xml")).mapInArrow(run, schema)


def gather(records: DataFrame, keep: list[str], names: list[str] | None = None, separator: str = "; ") -> DataFrame:
    """One row per keep, a column per name, its non-empty values joined in order.  Names are read once if not given."""
    good = records.where(F.col("value").isNotNull() & ~F.lower("value").isin("", "none", "nan"))
    if names is None:
        names = sorted(r[0] for r in good.select("name").distinct().collect())
    lists = good.groupBy(*keep, "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]), separator).alias("value"))
    return lists.groupBy(*keep).pivot("name", names).agg(F.first("value"))
