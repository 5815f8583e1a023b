"""Queries on links, trees and relational-to-graph mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links, trees
from ..operators.joins import disjunctive_join, distinct
from .mapping import PredicateObject, Term, TriplesMap, compile_mapping, read_mapping
from .queries_scores import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- links ----

_CELL = """case when l_orderkey % 10 = 9 then 'broken' else '{"links":{"from":[{"refId":' || l_linenumber || ',"referenceType":"' || l_returnflag || '","target":{"id":' || l_partkey || ',"type":" Dataset "},"source":{"id":"' || l_suppkey || '","typeId":"10"}}],"to":[{"referenceType":"","target":{"id":' || l_partkey || ',"typeId":1},"source":{"typeId":7}}]}}' end"""


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CELL).alias("cell"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN b THEN '' ELSE 'from [' || l_linenumber || ']' END AS links_dir_refids, CASE WHEN b THEN '' ELSE l_partkey || '; ' || l_partkey END AS links_target_ids, CASE WHEN b THEN '' ELSE l_suppkey::VARCHAR END AS links_source_ids, CASE WHEN b THEN '' ELSE l_returnflag END AS links_reference_types
FROM (SELECT *, l_orderkey % 10 = 9 AS b FROM lineitem) AS l"""
)
def extract_links_v1(spark, sf_dir):
    return links.extract_links(_cells(spark, sf_dir), "cell", types=False).drop("cell")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN b THEN '' ELSE 'from [' || l_linenumber || ']' END AS links_dir_refids, CASE WHEN b THEN '' ELSE l_partkey::VARCHAR END AS links_target_ids, CASE WHEN b THEN '' ELSE l_suppkey::VARCHAR END AS links_source_ids, CASE WHEN b THEN '' ELSE l_returnflag END AS links_reference_types, CASE WHEN b THEN '' ELSE 'dataset' END AS links_target_types, CASE WHEN b THEN '' ELSE 'publication' END AS links_source_types
FROM (SELECT *, l_orderkey % 10 = 9 AS b FROM lineitem) AS l"""
)
def extract_links(spark, sf_dir):
    return links.extract_links(_cells(spark, sf_dir), "cell", dedup=True).drop("cell")


@query(
    """SELECT l_orderkey, l_linenumber, 'Publication' AS links_source_types, l_suppkey::VARCHAR AS links_source_ids, l_returnflag AS links_reference_types, 'Dataset' AS links_target_types, l_partkey::VARCHAR AS links_target_ids FROM lineitem WHERE l_orderkey % 10 <> 9
UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, '', 'Dataset', l_partkey::VARCHAR FROM lineitem WHERE l_orderkey % 10 <> 9"""
)
def explode_links(spark, sf_dir):
    return links.explode_links(_cells(spark, sf_dir), "cell", ["l_orderkey", "l_linenumber"])


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dataset' WHEN 1 THEN 'publication' WHEN 2 THEN lower(p_brand) END AS type FROM part")
def normalize_type(spark, sf_dir):
    end = F.expr("named_struct('type', case p_partkey % 4 when 2 then ' ' || p_brand || ' ' when 1 then ' ' end, 'typeId', case p_partkey % 4 when 0 then '1' when 1 then ' 10 ' when 3 then 'x' end)")
    return table(spark, sf_dir, "part").select("p_partkey", links.normalize_type(end).alias("type"))


# ---- trees ----

_TREE = """'{"title": "' || o_orderstatus || '", "total": ' || o_custkey || ', "by": {"first name": "' || o_orderpriority || '", "tags": ["a", {"b": ' || o_orderkey || '}]}, "none": null}'"""


def _trees(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TREE).alias("json"))


@query(
    """SELECT o_orderkey, path, kind, value FROM (
SELECT o_orderkey, unnest(['title', 'total', 'by', 'none', 'by/first_name', 'by/tags', 'by/tags/0', 'by/tags/1', 'by/tags/1/b']) AS path, unnest(['leaf', 'leaf', 'object', 'leaf', 'leaf', 'array', 'leaf', 'object', 'leaf']) AS kind, unnest([o_orderstatus, o_custkey::VARCHAR, NULL, NULL, o_orderpriority, NULL, 'a', NULL, o_orderkey::VARCHAR]) AS value FROM orders) AS t"""
)
def tree_walk(spark, sf_dir):
    return trees.walk(_trees(spark, sf_dir), "json", ["o_orderkey"]).select("o_orderkey", trees.path_text(F.col("path")).alias("path"), "kind", "value")


@query(
    """SELECT 'http://example.org/order/' || o_orderkey AS subject, unnest(['title', 'total', 'by_first name']) AS predicate, unnest([o_orderstatus, o_custkey::VARCHAR, o_orderpriority]) AS object FROM orders"""
)
def triples_shallow(spark, sf_dir):
    return trees.shallow_triples(_trees(spark, sf_dir), "json", key="o_orderkey", base="http://example.org/order/")


@query(
    """WITH o AS (SELECT *, 'http://e.org/' || o_orderkey AS r FROM orders)
SELECT unnest([r, r, r, r || '/by', r || '/by', r || '/by/tags', r || '/by/tags', r || '/by/tags/1']) AS subject, unnest(['title', 'total', 'by', 'first name', 'tags', 'tags', 'tags', 'b']) AS predicate,
unnest([o_orderstatus, o_custkey::VARCHAR, r || '/by', o_orderpriority, r || '/by/tags', r || '/by/tags/0', r || '/by/tags/1', o_orderkey::VARCHAR]) AS object, unnest(['literal', 'literal', 'iri', 'literal', 'iri', 'iri', 'iri', 'literal']) AS object_kind FROM o"""
)
def triples_deep(spark, sf_dir):
    return trees.deep_triples(_trees(spark, sf_dir), "json", key="o_orderkey", base="http://e.org/")


@query("SELECT n_nationkey, n_name || '; ' || n_nationkey AS \"Name\", n_regionkey::VARCHAR AS \"Region\" FROM nation")
def xml_records(spark, sf_dir):
    xml = F.expr("'<Dataset id=\"' || n_nationkey || '\"><a><n name=\"Name\">' || n_name || '</n><n name=\"Name\"> ' || n_nationkey || ' </n></a><b><c name=\"Region\">' || n_regionkey || '</c><c>x</c></b></Dataset>'")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", xml.alias("xml"))
    return trees.gather(trees.xml_records(rows, "xml", ["n_nationkey"]), ["n_nationkey"], ["Name", "Region"])


@query("SELECT n_nationkey AS \"n_key\", n_name AS \"n_at_name\", n_regionkey AS \"n_at_region\" FROM nation")
def flatten_columns(spark, sf_dir):
    nested = table(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("@name"), F.col("n_regionkey").alias("region")).alias("at")).alias("n"))
    return trees.flatten_columns(nested)


# ---- graph mappings ----
# Customers stand in for publications, suppliers for datasets, line items for links.


def _tables(spark, sf_dir):
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    publications = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.col("c_name"), F.lit(" ü/%")).alias("title"),
        F.when(F.col("c_custkey") % 3 == 0, "Forest").alias("forest"),
        F.when(F.col("c_custkey") % 2 == 0, "Grassland").alias("grassland"),
        F.substring("c_mktsegment", 1, 2).alias("plot_level_clean"),
        F.col("n_name").alias("alb_notation"),
        F.sha2(F.trim(F.lower("n_name")), 256).alias("project_hash"),
    )
    datasets = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("title"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")).alias("project_hash"), F.when(F.col("s_suppkey") % 7 == 0, F.col("s_name")).alias("projects_core_hash"))
    # Numbers give the same texts where they are equal, and only there.
    lines = distinct(table(spark, sf_dir, "lineitem").select(((F.col("l_linenumber") % 2) == 1).alias("forward"), ((F.col("l_partkey") % 400) + 1).alias("publication"), "l_suppkey", "l_returnflag"))
    forward = F.col("forward")
    a, b = (F.lit("Publication"), F.col("publication").cast("string")), (F.lit("Dataset"), F.col("l_suppkey").cast("string"))
    rows = lines.select(
        F.when(forward, a[0]).otherwise(b[0]).alias("links_source_types"), F.when(forward, a[1]).otherwise(b[1]).alias("links_source_ids"), F.col("l_returnflag").alias("links_reference_types"),
        F.when(forward, b[0]).otherwise(a[0]).alias("links_target_types"), F.when(forward, b[1]).otherwise(a[1]).alias("links_target_ids"),
    )
    return {"be_publication_metadata": publications, "be_dataset_metadata": datasets, "be_links": rows}


_SQL = """
WITH be_publication_metadata AS (SELECT c_custkey::VARCHAR AS id, c_name || ' ü/%' AS title, CASE WHEN c_custkey % 3 = 0 THEN 'Forest' END AS forest, CASE WHEN c_custkey % 2 = 0 THEN 'Grassland' END AS grassland, substring(c_mktsegment, 1, 2) AS plot_level_clean, n_name AS alb_notation, sha256(trim(lower(n_name))) AS project_hash FROM customer JOIN nation ON c_nationkey = n_nationkey),
be_dataset_metadata AS (SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS title, CASE WHEN s_suppkey % 5 = 0 THEN s_name END AS project_hash, CASE WHEN s_suppkey % 7 = 0 THEN s_name END AS projects_core_hash FROM supplier),
be_links AS (SELECT DISTINCT CASE WHEN f THEN 'Publication' ELSE 'Dataset' END AS links_source_types, CASE WHEN f THEN p ELSE d END AS links_source_ids, l_returnflag AS links_reference_types, CASE WHEN f THEN 'Dataset' ELSE 'Publication' END AS links_target_types, CASE WHEN f THEN d ELSE p END AS links_target_ids FROM (SELECT l_returnflag, l_linenumber % 2 = 1 AS f, ((l_partkey % 400) + 1)::VARCHAR AS p, l_suppkey::VARCHAR AS d FROM lineitem) AS l)
"""

_BASE = "http://example.com/base/"
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _iri(template: str) -> Term:
    return Term(template=template, kind="iri")


def _const(value: str, kind: str = "iri") -> Term:
    return Term(constant=value, kind=kind)


def _pom(predicate: Term, *objects: Term, graphs: tuple[Term, ...] = ()) -> PredicateObject:
    return PredicateObject([predicate], list(objects), list(graphs))


def _quads(spark, sf_dir, *maps: TriplesMap):
    return compile_mapping(spark, list(maps), _tables(spark, sf_dir))


def _show(graph: str, subject: str, predicate: str, obj: str, kind: str = "iri", lang: str = "NULL", where: str = "TRUE", frm: str = "be_publication_metadata") -> str:
    return f"SELECT DISTINCT {graph} AS graph, {subject} AS subject, {predicate} AS predicate, {obj} AS object, '{kind}' AS object_kind, {lang}::VARCHAR AS lang, NULL::VARCHAR AS datatype FROM {frm} WHERE {where}"


_PUB = f"'{_BASE}Publication_' || id"


@query(_SQL + " UNION ALL ".join([_show("''", _PUB, f"'{_TYPE}'", "'ex:Publication'"), _show("''", _PUB, "'ex:title'", "title", "literal")]))
def kg_entities(spark, sf_dir):
    return _quads(spark, sf_dir, TriplesMap("pub", "be_publication_metadata", subject=_iri(_BASE + "Publication_{id}"), classes=["ex:Publication"], properties=[_pom(_const("ex:title"), Term(column="title", kind="literal"))]))


@query(_SQL + " UNION ALL ".join([_show("''", f"'{_BASE}' || {c} || '_Plot_' || id", f"'{_TYPE}'", "'ex:Plot'", where=f"{c} IS NOT NULL") for c in ("forest", "grassland")]))
def kg_gated_nodes(spark, sf_dir):
    return _quads(spark, sf_dir, *[TriplesMap(c, "be_publication_metadata", subject=_iri(f"{_BASE}{{{c}}}_Plot_{{id}}"), classes=["ex:Plot"]) for c in ("forest", "grassland")])


_ENC = "replace(replace(replace(title, '%', '%25'), ' ', '%20'), '/', '%2F')"


@query(_SQL + " UNION ALL ".join([_show("''", _PUB, "'ex:at'", f"'{_BASE}' || plot_level_clean || replace(alb_notation, ' ', '%20')"), _show("''", _PUB, "'ex:at'", f"'{_BASE}' || replace(replace(replace(replace(title, '%', '%25'), '#', '%23'), ' ', '%20'), '/', '%2F')")]))
def kg_multi_object(spark, sf_dir):
    return _quads(spark, sf_dir, TriplesMap("pub", "be_publication_metadata", subject=_iri(_BASE + "Publication_{id}"), properties=[_pom(_const("ex:at"), _iri(_BASE + "{plot_level_clean}{alb_notation}"), _iri(_BASE + "{title}"))]))


@query(_SQL + " UNION ALL ".join([_show("''", _PUB, "'ex:label'", "'Publication: ' || title", "literal", "'en'"), _show("''", _PUB, "'ex:label'", "'fixed_label'", "literal", "'de'")]))
def kg_lang_labels(spark, sf_dir):
    return _quads(spark, sf_dir, TriplesMap("pub", "be_publication_metadata", subject=_iri(_BASE + "Publication_{id}"), properties=[_pom(_const("ex:label"), Term(template="Publication: {title}", kind="literal", language="en"), Term(template="fixed_label", kind="literal", language="de"))]))


@query(_SQL + _show(f"'{_BASE}unit/' || forest || '_' || id", _PUB, "'ex:title'", "title", "literal", where="forest IS NOT NULL"))
def kg_named_graphs(spark, sf_dir):
    unit = _iri(_BASE + "unit/{forest}_{id}")
    return _quads(spark, sf_dir, TriplesMap("pub", "be_publication_metadata", subject=_iri(_BASE + "Publication_{id}"), properties=[_pom(_const("ex:title"), Term(column="title", kind="literal"), graphs=(unit, unit))]))


@query(_SQL + " UNION ALL ".join([_show("''", f"'{_BASE}Programme'", f"'{_TYPE}'", "'ex:Process'"), _show("''", f"'{_BASE}Programme'", "'ex:label'", "'Programme'", "literal", "'en'")]))
def kg_constants(spark, sf_dir):
    return _quads(spark, sf_dir, TriplesMap("programme", "be_publication_metadata", subject=_const(_BASE + "Programme"), classes=["ex:Process"], properties=[_pom(_const("ex:label"), Term(constant="Programme", kind="literal", language="en"))]))


_LINK_SQL = "links_source_types || '_' || links_source_ids"


@query(_SQL + _show(f"'{_BASE}link/' || {_LINK_SQL}", f"'{_BASE}' || {_LINK_SQL}", "'http://example.com/prop/' || links_reference_types", f"'{_BASE}' || links_target_types || '_' || links_target_ids", frm="be_links"))
def kg_dynamic_predicate(spark, sf_dir):
    m = TriplesMap("links", "be_links", subject=_iri(_BASE + "{links_source_types}_{links_source_ids}"), graphs=[_iri(_BASE + "link/{links_source_types}_{links_source_ids}")], properties=[_pom(_iri("http://example.com/prop/{links_reference_types}"), _iri(_BASE + "{links_target_types}_{links_target_ids}"))])
    return _quads(spark, sf_dir, m)


@query(_SQL + " UNION ALL ".join([_show("''", f"'{_BASE}unit/Publication_' || id", f"'{_TYPE}'", "'ex:NamedIndividualUnit'"), _show("''", f"'{_BASE}unit/Publication_' || id", "'ex:semanticUnitSubject'", _PUB)]))
def kg_parent_ref(spark, sf_dir):
    pub = TriplesMap("pub", "be_publication_metadata", subject=_iri(_BASE + "Publication_{id}"))
    unit = TriplesMap("unit", "be_publication_metadata", subject=_iri(_BASE + "unit/Publication_{id}"), properties=[_pom(_const(_TYPE), _const("ex:NamedIndividualUnit")), _pom(_const("ex:semanticUnitSubject"), Term(parent="pub", kind="iri"))])
    return _quads(spark, sf_dir, pub, unit)


_UNIT_TTL = """
@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix ex: <http://example.com/ns/> .
<#Unit> a rr:TriplesMap ;
  rr:logicalTable [ rr:tableName "be_dataset_metadata" ] ;
  rr:subjectMap [ rr:template "http://example.com/base/unit/Dataset_{id}" ; rr:class ex:Unit, ex:Statement ] ;
  rr:predicateObjectMap [ rr:predicate ex:about ; rr:objectMap [ rr:template "http://example.com/base/Dataset_{id}" ; rr:termType rr:IRI ] ] ;
  rr:predicateObjectMap [ rr:predicate ex:title ; rr:objectMap [ rr:column "title" ] ; rr:graphMap [ rr:template "http://example.com/base/g/{id}" ] ] .
"""


@query(
    _SQL
    + " UNION ALL ".join(
        [
            *[_show("''", f"'{_BASE}unit/Dataset_' || id", f"'{_TYPE}'", f"'http://example.com/ns/{c}'", frm="be_dataset_metadata") for c in ("Unit", "Statement")],
            _show("''", f"'{_BASE}unit/Dataset_' || id", "'http://example.com/ns/about'", f"'{_BASE}Dataset_' || id", frm="be_dataset_metadata"),
            _show(f"'{_BASE}g/' || id", f"'{_BASE}unit/Dataset_' || id", "'http://example.com/ns/title'", "title", "literal", where="title IS NOT NULL", frm="be_dataset_metadata"),
        ]
    )
)
def kg_units(spark, sf_dir):
    return compile_mapping(spark, read_mapping(_UNIT_TTL), _tables(spark, sf_dir))


_LINK_PAIRS = """SELECT DISTINCT x.publication_id, x.dataset_id FROM (
  SELECT CASE WHEN links_source_types = 'Dataset' THEN links_source_ids ELSE links_target_ids END AS dataset_id,
         CASE WHEN links_source_types = 'Publication' THEN links_source_ids ELSE links_target_ids END AS publication_id
  FROM be_links WHERE links_source_types IN ('Dataset', 'Publication') AND links_target_types IN ('Dataset', 'Publication')) AS x
JOIN be_dataset_metadata AS d ON d.id = x.dataset_id JOIN be_publication_metadata AS p ON p.id = x.publication_id"""


@query(_SQL + _LINK_PAIRS)
def view_link_pairs(spark, sf_dir):
    for name, df in _tables(spark, sf_dir).items():
        df.createOrReplaceTempView(name)
    return spark.sql(_LINK_PAIRS)


_COMPOUND = """SELECT DISTINCT p.id AS pub_id, l.links_source_types, l.links_source_ids, l.links_reference_types, l.links_target_types, l.links_target_ids, d.id AS id, d.project_hash AS project_hash, d.projects_core_hash AS projects_core_hash
FROM be_publication_metadata AS p JOIN be_links AS l ON (l.links_source_types = 'Publication' AND l.links_source_ids = p.id) OR (l.links_target_types = 'Publication' AND l.links_target_ids = p.id)
LEFT JOIN be_dataset_metadata AS d ON (l.links_source_types = 'Dataset' AND l.links_source_ids = d.id) OR (l.links_target_types = 'Dataset' AND l.links_target_ids = d.id)"""


def _compound(spark, sf_dir):
    t = _tables(spark, sf_dir)
    end = lambda kind: [(F.when(F.col(f"links_{s}_types") == kind, F.col(f"links_{s}_ids")), "id") for s in ("source", "target")]
    publications = t["be_publication_metadata"].select("id")
    linked = disjunctive_join(t["be_links"], publications, end("Publication")).withColumnRenamed("id", "pub_id")
    return distinct(disjunctive_join(linked, t["be_dataset_metadata"].select("id", "project_hash", "projects_core_hash"), end("Dataset"), how="left"))


@query(_SQL + _COMPOUND)
def view_compound(spark, sf_dir):
    return _compound(spark, sf_dir)


@query(
    _SQL
    + f", v AS ({_COMPOUND}) "
    + " UNION ALL ".join(
        [
            _show("''", f"'{_BASE}compound/Publication_' || pub_id", "'ex:hasUnit'", f"'{_BASE}link/' || links_source_types || '_' || links_source_ids || '__' || links_target_ids", frm="v"),
            _show("''", f"'{_BASE}compound/Publication_' || pub_id", "'ex:hasUnit'", f"'{_BASE}output/' || replace(replace(project_hash, ' ', '%20'), '#', '%23') || '_Dataset_' || id", where="project_hash IS NOT NULL AND id IS NOT NULL", frm="v"),
        ]
    )
)
def kg_compound(spark, sf_dir):
    m = TriplesMap("compound", query="view", subject=_iri(_BASE + "compound/Publication_{pub_id}"), properties=[_pom(_const("ex:hasUnit"), _iri(_BASE + "link/{links_source_types}_{links_source_ids}__{links_target_ids}"), _iri(_BASE + "output/{project_hash}_Dataset_{id}"))])
    return compile_mapping(spark, [m], {}, {"compound": _compound(spark, sf_dir)})


