"""Queries on sources, sinks, headers, small scalars and whole runs; files go to scratch folders and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stopwords, text
from ..operators import assign, cluster, ctfidf, evaluate, headers, links, records, trees
from ..sources import files, sinks
from . import mapping, pipelines
from .queries_scores import _SCORES, _UNIT, best, table
from .queries_text import _LETTERS, _SHOW, _shown, _tfidf_sql, norm

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- sources and sinks ----


@query("SELECT p_partkey, p_name || '\n\"ü\", ' || p_brand AS name, p_size, p_retailprice FROM part")
def csv_typed(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.concat("p_name", F.lit('\n"ü", '), "p_brand").alias("name"), "p_size", "p_retailprice")
    sinks.write_csv(rows, path := files.scratch(spark, "csv"))
    df = files.read_csv(spark, path, types=True)
    return df.select(F.col("p_partkey").cast("long"), "name", F.col("p_size").cast("long"), F.col("p_retailprice").cast("double"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, '' AS none FROM part")
def csv_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"))
    sinks.write_csv(rows, path := files.scratch(spark, "csv"), ["p_partkey", "name", "none"], blank=True)
    return files.read_csv(spark, path, strings=True)


@query("SELECT vec_id::VARCHAR AS id, len(embedding)::INTEGER AS size, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vectors_round_trip(spark, sf_dir):
    sinks.write_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), path := files.scratch(spark, "vectors"))
    return files.read_embeddings(spark, path).select("id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE n_regionkey || '|x' END AS regions FROM nation")
def xml_rows(spark, sf_dir):
    xml = F.expr("'<Dataset id=\"' || n_nationkey || '\"><Name>' || n_name || '</Name><Region>' || n_regionkey || '</Region>' || case when n_nationkey % 2 = 1 then '<Region>x</Region>' else '' end || '</Dataset>'")
    whole = table(spark, sf_dir, "nation").agg(F.concat(F.lit("<Datasets>"), F.array_join(F.collect_list(xml), ""), F.lit("</Datasets>")).alias("value"))
    whole.write.text(path := files.scratch(spark, "xml"))
    rows = trees.read_xml(spark, path, "Dataset", "_id long, Name string, Region array<string>")
    return rows.select(F.col("_id").alias("id"), F.col("Name").alias("name"), F.array_join("Region", "|").alias("regions"))


@query("SELECT CASE WHEN event_id % 4 <> 3 THEN event_id::VARCHAR END AS id, CASE WHEN event_id % 4 <> 3 THEN props END AS raw, CASE WHEN event_id % 4 = 3 THEN 'unreadable line: {broken ' || event_id END AS error, row_number() OVER (ORDER BY event_id) AS line FROM events")
def json_lines(spark, sf_dir):
    line = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("props").alias("raw"))))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    rows.coalesce(1).sortWithinPartitions("event_id").select("value").write.text(path := files.scratch(spark, "lines"))
    return files.read_json_lines(spark, path)


@query("SELECT p_partkey, p_name || ' ü' AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS size FROM part")
def json_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" ü")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("size"))
    sinks.write_json_lines(rows, path := files.scratch(spark, "json"))
    return spark.read.schema(rows.schema).json(path)


@query("SELECT value, count(*) AS n FROM (SELECT unnest(['{', '  \"r_regionkey\" : ' || r_regionkey || ',', '  \"r_name\" : \"' || r_name || '\"', '}']) AS value FROM region) AS l GROUP BY value")
def pretty_json(spark, sf_dir):
    sinks.write_pretty_json(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path := files.scratch(spark, "pretty"))
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


_ENTRY = "'{\"name\": \"' || n_name || '\", \"at\": [{\"region\": ' || n_regionkey || '}]}'"


@query(
    """WITH r AS (SELECT n_nationkey::VARCHAR AS entry, 'http://e.org/' || n_nationkey AS i, n_name, n_regionkey FROM nation), l AS (
SELECT entry, '<' || i || '> <http://e.org/p/at> <' || i || '/at> ;' AS value FROM r
UNION ALL SELECT entry, '    <http://e.org/p/name> "' || n_name || '" ;' FROM r UNION ALL SELECT entry, '    <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e.org/Entry> .' FROM r
UNION ALL SELECT entry, '<' || i || '/at> <http://e.org/p/at> <' || i || '/at/0> .' FROM r UNION ALL SELECT entry, '<' || i || '/at/0> <http://e.org/p/region> "' || n_regionkey || '" .' FROM r)
SELECT entry, value FROM l"""
)
def turtle_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_ENTRY).alias("json"))
    graph = trees.entry_graph(rows, "json", key="n_nationkey", base="http://e.org/", predicate_base="http://e.org/p/", root_type="http://e.org/Entry")
    sinks.write_turtle(graph, path := files.scratch(spark, "turtle"), by="entry")
    return spark.read.text(path).select(F.col("entry").cast("string").alias("entry"), "value")


@query("SELECT DISTINCT 'http://e.org/dataset/' || l_partkey AS subject, 'http://purl.org/dc/terms/isPartOf' AS predicate, 'http://e.org/publication/' || l_suppkey AS object FROM lineitem WHERE l_orderkey % 10 <> 9")
def part_of(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_orderkey") % 10 != 9, F.col("l_suppkey")).alias("l_suppkey"))
    return links.part_of(rows, dataset="l_partkey", publication="l_suppkey", dataset_base="http://e.org/dataset/", publication_base="http://e.org/publication/", predicate="http://purl.org/dc/terms/isPartOf")


_CONFUSED = "count(*) FILTER (quality = {g} AND toxic = {p})"


@query(
    f"""SELECT '"",gold_yes,gold_no' AS value UNION ALL SELECT 'pred_yes,' || {_CONFUSED.format(g=1, p=1)} || ',' || {_CONFUSED.format(g=0, p=1)} FROM labels
UNION ALL SELECT 'pred_no,' || {_CONFUSED.format(g=1, p=0)} || ',' || {_CONFUSED.format(g=0, p=0)} FROM labels"""
)
def confusion_csv(spark, sf_dir):
    cells = table(spark, sf_dir, "labels").select(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("p"), F.col("quality").cast("string").alias("g"))
    sinks.write_confusion(evaluate.confusion(evaluate.yesno(cells), "toxic"), path := files.scratch(spark, "confusion"))
    return spark.read.text(path)


@query("SELECT unnest(['Aligned ids: ' || count(*), 'numeric: size', 'yesno: toxic']) AS line FROM labels")
def eval_report(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    made = evaluate.yesno(rows.select(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("p"), F.col("quality").cast("string").alias("g")))
    made = made.unionByName(evaluate.numeric(rows.select(F.lit("size").alias("field"), F.lit("1").alias("p"), F.lit("2").alias("g"))), allowMissingColumns=True)
    return spark.createDataFrame([(x,) for x in sinks.report(made, rows.count()).strip().split("\n")], "line string")


@query("SELECT least(7, count(*)) AS n FROM orders")
def first_rows(spark, sf_dir):
    return files.first_rows(table(spark, sf_dir, "orders"), 7).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS \"n:ame\", n_regionkey FROM nation")
def rename_columns(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").withColumnsRenamed(evaluate.parse_renames("n_nationkey:id, n_name : n:ame ,broken, :x, n_regionkey:"))


@query("SELECT n_nationkey AS id, n_name AS \"Metadata_id\", n_name AS \"a_#text\" FROM nation")
def text_columns(spark, sf_dir):
    return headers.text_columns(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("Metadata_id"), F.col("n_name").alias("a_#text"), F.col("n_regionkey").alias("other")))


@query("SELECT n_nationkey AS \"a\", n_name AS \"a 2\", n_regionkey AS \"Types\" FROM nation")
def strip_type(spark, sf_dir):
    return headers.strip_type(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("aType"), F.col("n_name").alias("a"), F.col("n_regionkey").alias("Types")))


@query("SELECT n_nationkey AS \"Id\", n_name AS \"Dataset Id\", n_regionkey AS \"First Name\" FROM nation")
def header_dedup(spark, sf_dir):
    return headers.simplify(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("Metadata_general_idType_#text"), F.col("n_regionkey").alias("Metadata_contacts_firstName_#text")))


@query("SELECT unnest(['a,id,Id', 'ID,b', 'x,y']) AS columns, unnest(['id', 'ID', 'x']) AS id")
def id_column(spark, sf_dir):
    cases = ["a,id,Id", "ID,b", "x,y"]
    return spark.createDataFrame([(c, evaluate.autodetect_id(c.split(","))) for c in cases], "columns string, id string")


# ---- joins, scores, topics ----


@query(_SCORES + "SELECT t.id, winner, label, 'embeddings' AS source FROM top AS t JOIN embeddings AS e ON e.vec_id = t.id")
def documents_with_winners(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rows.join(best(spark, sf_dir, 1).select("id", "winner"), "id").withColumn("source", F.lit("embeddings"))


@query("SELECT count(*) AS n FROM embeddings")
def align_by_place(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return assign.align_by_place(rows.select("vec_id", "label"), rows.select("vec_id", "embedding"), "vec_id").agg(F.count("*").alias("n"))


@query(
    _UNIT.replace("SELECT vec_id, label,", "SELECT vec_id, label % 4 AS label,")
    + ", s AS (SELECT e.vec_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 9) AS score FROM embeddings AS e CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM s) SELECT vec_id AS id, label AS winner, round(score, 6) AS top1 FROM r WHERE n = 1"
)
def super_assignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    centres = cluster.centroids(rows.withColumn("super", F.col("label") % 4), cls="super", vec="embedding")
    top = assign.best_anchors(rows, centres, 1, doc_id="vec_id", anchor_id="class", anchor_vec="centroid", digits=9)
    return top.select("id", "winner", F.round("top1", 6).alias("top1"))


@query("SELECT count(DISTINCT CASE WHEN label <> 0 THEN label END) AS n_clusters, count(*) FILTER (label = 0) AS n_outliers FROM embeddings")
def cluster_counts(spark, sf_dir):
    return cluster.outliers(table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), (F.col("label") == 0).alias("is_outlier")))


@query(_tfidf_sql("lang", r"[\p{L}\p{N}_][\p{L}\p{N}_\-''’]*[\p{L}\p{N}_]", "", 3, "regexp_matches(t, '^\\p{L}') AND ", stopwords.union(), 2, "least(5, (SELECT k FROM k))", 10, _SHOW))
def ctfidf_goals(spark, sf_dir):
    return _shown(ctfidf.class_tfidf(table(spark, sf_dir, "documents"), cls="lang", text="text", pattern=ctfidf.PATTERN_GOAL, stop=stopwords.union(), ngram_max=2, k_policy="non_empty", cap_min_df=True))


@query(_tfidf_sql("source", _LETTERS, _LETTERS + "+", 2, "", stopwords.union(), 2, "5", 12, _SHOW))
def ctfidf_clusters(spark, sf_dir):
    return _shown(ctfidf.class_tfidf(table(spark, sf_dir, "documents"), cls="source", text="text", stop=stopwords.union(), ngram_max=2, top_k=12))


@query("SELECT p_partkey, p_brand || ' — ' || array_to_string(list_slice(string_split(p_name, ' '), 1, 2), ', ') AS label, 'S' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS code FROM part")
def super_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ctfidf.super_label(F.col("p_brand"), F.split("p_name", " ")).alias("label"), F.format_string("S%04d", F.col("p_partkey") % 10000).alias("code"))


# ---- evaluation ----

_REVIEW = "count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fp, count(*) FILTER (toxic <> 1 AND quality = 1) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 1) AS tn, count(*) AS n"
_WIDE = ["accuracy", "precision", "recall", "f1", "tp", "fp", "fn", "tn", "exact_match", "mae", "rmse", "micro_precision", "micro_recall", "micro_f1", "avg_soft_jaccard", "avg_match_similarity", "subset_accuracy", "avg_jaccard"]


def _row(source: str, field: str, kind: str, support: str, **values: str) -> str:
    return f"SELECT '{field}' AS field, '{kind}' AS type, {support} AS support, " + ", ".join(f"{values[c]} AS {c}" if c in ("tp", "fp", "fn", "tn") and c in values else f"round({values[c]}, 6) AS {c}" if c in values else f"NULL AS {c}" for c in _WIDE) + f" FROM {source}"


EVAL_SUMMARY = (
    f"WITH y AS (SELECT {_REVIEW} FROM labels), m AS (SELECT sum(i) AS i, sum(2 - i) AS d, avg(CASE WHEN i = 2 THEN 1.0 ELSE 0.0 END) AS s, avg(i / (4 - i)) AS j, count(*) AS n FROM (SELECT 1 + (doc_id % 3 = doc_id % 2)::INTEGER AS i FROM labels) AS x), u AS (SELECT avg((p = g)::INTEGER) AS e, avg(abs(p - g)) AS a, sqrt(avg((p - g) * (p - g))) AS r, count(*) AS n FROM (SELECT doc_id % 7 AS p, doc_id % 5 AS g FROM labels) AS x) "
    + _row("y", "review", "yesno", "n", accuracy="(tp + tn) / n", precision="CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", recall="CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END", f1="CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END", tp="tp", fp="fp", fn="fn", tn="tn")
    + " UNION ALL " + _row("u", "number_of_ep", "numeric", "n", exact_match="e", mae="a", rmse="r")
    + " UNION ALL " + _row("m", "study_design", "fuzzy-list", "n", micro_precision="1.0", micro_recall="1.0", micro_f1="1.0", avg_soft_jaccard="1.0", avg_match_similarity="0.9375")
    + " UNION ALL " + _row("m", "keywords", "multilabel", "n", micro_precision="i / (i + d)", micro_recall="i / (i + d)", micro_f1="i / (i + d)", subset_accuracy="s", avg_jaccard="j")
)
ORACLES["eval_summary"] = EVAL_SUMMARY

#: The longest common subsequence as the longest chain of matching places.
_LCS = """WITH RECURSIVE t AS (SELECT a.p_partkey, string_split(a.p_name, ' ') AS p, string_split(b.p_name, ' ') AS g FROM part AS a JOIN part AS b ON a.p_partkey + 1 = b.p_partkey),
x AS (SELECT p_partkey, unnest(p) AS w, unnest(range(len(p))) AS i FROM t), y AS (SELECT p_partkey, unnest(g) AS w, unnest(range(len(g))) AS j FROM t),
m AS (SELECT x.p_partkey, i, j FROM x JOIN y ON x.p_partkey = y.p_partkey AND x.w = y.w),
chain AS (SELECT p_partkey, i, j, 1 AS n FROM m UNION SELECT m.p_partkey, m.i, m.j, n + 1 FROM chain JOIN m ON m.p_partkey = chain.p_partkey AND m.i > chain.i AND m.j > chain.j),
l AS (SELECT p_partkey, max(n) AS n FROM chain GROUP BY p_partkey),
s AS (SELECT p_partkey, coalesce(n, 0) / len(p) AS p, coalesce(n, 0) / len(g) AS r FROM t LEFT JOIN l USING (p_partkey)),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM s) """
ORACLES["rouge_l"] = _LCS + "SELECT p_partkey, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM f"


#: Greedy matching: the best pair whose ends are both free, one after the other.
ORACLES["fuzzy_match"] = """WITH RECURSIVE t AS (SELECT a.p_partkey AS k, string_split(a.p_name, ' ') AS p, string_split(b.p_name, ' ') AS g FROM part AS a JOIN part AS b ON a.p_partkey + 1 = b.p_partkey),
x AS (SELECT k, v, i FROM (SELECT k, p, unnest(p) AS v, unnest(range(len(p))) AS i FROM t) AS x WHERE list_position(p, v) = i + 1), y AS (SELECT k, v, j FROM (SELECT k, g, unnest(g) AS v, unnest(range(len(g))) AS j FROM t) AS y WHERE list_position(g, v) = j + 1),
m AS (SELECT x.k, i, j, 1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v), 1) AS sim FROM x JOIN y ON x.k = y.k WHERE 1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v), 1) >= 0.5),
pick AS (SELECT k, 0 AS n, 0.0::DOUBLE AS sims, []::BIGINT[] AS ui, []::BIGINT[] AS uj FROM t
UNION ALL SELECT k, n + 1, sims + sim, list_append(ui, i), list_append(uj, j) FROM (SELECT pick.k, n, sims, ui, uj, arg_max(m.i, round(sim, 9) * 1e12 + i * 1e3 + j) AS i, arg_max(m.j, round(sim, 9) * 1e12 + i * 1e3 + j) AS j, max(sim) AS sim FROM pick JOIN m ON m.k = pick.k WHERE NOT list_contains(ui, m.i) AND NOT list_contains(uj, m.j) GROUP BY pick.k, n, sims, ui, uj) AS s)
SELECT k AS p_partkey, max(n)::INTEGER AS n, round(max(sims), 6) AS sims FROM pick GROUP BY k"""


@query(_LCS + "SELECT 'name' AS field, count(*) AS support, round(avg(p), 6) AS rougeL_p, round(avg(r), 6) AS rougeL_r, round(avg(f1), 6) AS rougeL_f1, 'free-text' AS type FROM f")
def freetext_metrics(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("p"))
    b = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("g"))
    blank = spark.createDataFrame([("name", " ", None)], "field string, p string, g string")
    cells = a.join(b, "p_partkey").select(F.lit("name").alias("field"), "p", "g").unionByName(blank)
    return evaluate.freetext(cells).select("field", "support", *[F.round(c, 6).alias(c) for c in ("rougeL_p", "rougeL_r", "rougeL_f1")], "type")


@query("SELECT count(*) FILTER (doc_id % 3 <> 0) AS n_valid, count(*) AS n_total FROM labels")
def valid_counts(spark, sf_dir):
    catalogue = spark.createDataFrame([("Turns", "how many", "integer")], "`category name` string, `category definition` string, `allowed answers` string")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.expr("'{\"turns\": ' || case when doc_id % 3 = 0 then '\"x\"' else cast(doc_id as string) end || '}'").alias("raw"))
    return records.counted(records.validate(rows, "raw", records.build_schema(catalogue, "labels")))


# ---- scalars ----


@query("SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN 'a|b c' WHEN 1 THEN '1|x' WHEN 2 THEN 'True' WHEN 3 THEN '' ELSE l_returnflag END AS items FROM lineitem")
def to_list(spark, sf_dir):
    v = F.expr("case l_orderkey % 5 when 0 then '\" a ; b c, \"' when 1 then '[1, \" x \", \"\", null]' when 2 then 'true' when 3 then 'null' else '\"' || l_returnflag || '\"' end")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(records.to_list(F.try_parse_json(v)), "|").alias("items"))


@query("SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'integer' ELSE array_to_string(list_distinct_kept, '|') END AS enum FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda w, i: list_position(string_split(p_name, ' '), w) = i) AS list_distinct_kept FROM part) AS p")
def allowed_answers_raw(spark, sf_dir):
    cell = F.when(F.col("p_partkey") % 2 == 0, " integer ").otherwise(F.concat(F.lit("'"), F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit("'")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.allowed_answers(cell, integers=False)["enum"], "|").alias("enum"))


@query("SELECT p_partkey, replace(p_name, ' ', '|') AS words, string_split(p_name, ' ')[1] AS first FROM part")
def word_lists(spark, sf_dir):
    listed = F.concat(F.lit(" ,"), F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(", "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.word_list(listed), "|").alias("words"), text.first_word(F.concat(F.lit(" \"*"), F.replace("p_name", F.lit(" "), F.lit(". ")))).alias("first"))


@query(f"SELECT p_partkey, {norm('c')} AS normal FROM (SELECT p_partkey, chr(160) || replace(p_name, ' ', chr(160) || ' ' || chr(8195)) || '’' || chr(12288) AS c FROM part) AS p")
def norm_text_blanks(spark, sf_dir):
    cell = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit("’　"))
    return table(spark, sf_dir, "part").select("p_partkey", text.norm_text(cell).alias("normal"))


# ---- mappings ----

_TERMS = """
@prefix rr: <http://www.w3.org/ns/r2rml#> .
<#P> a rr:TriplesMap ; rr:logicalTable [ rr:tableName "nation" ] ;
  rr:subjectMap [ rr:template "http://e.org/n/{n_nationkey}" ; rr:class <http://e.org/Nation> ] ;
  rr:predicateObjectMap [ rr:predicate <http://e.org/key> ; rr:objectMap [ rr:column "n_nationkey" ] ] ;
  rr:predicateObjectMap [ rr:predicate <http://e.org/at> ; rr:objectMap [ rr:column "link" ; rr:termType rr:IRI ] ] ;
  rr:predicateObjectMap [ rr:predicate <http://e.org/label> ; rr:objectMap [ rr:template "{n_name} / {n_regionkey}" ; rr:termType rr:Literal ] ] ;
  rr:predicateObjectMap [ rr:predicate <http://e.org/type> ; rr:objectMap [ rr:template "iao:dataset" ] ] .
<#Q> a rr:TriplesMap ; rr:logicalTable [ rr:sqlQuery "SELECT n_nationkey AS k, cast(n_regionkey / 2.0 AS DOUBLE) AS half FROM nation WHERE n_regionkey > 1" ] ;
  rr:subjectMap [ rr:template "http://e.org/n/{k}" ; rr:class <http://e.org/Nation> ] ;
  rr:predicateObjectMap [ rr:predicate <http://e.org/half> ; rr:objectMap [ rr:column "half" ] ] .
"""


@query(
    """WITH n AS (SELECT *, 'http://e.org/n/' || n_nationkey AS s FROM nation), x AS (SELECT 'http://www.w3.org/2001/XMLSchema#' AS x),
q AS (SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://e.org/Nation' AS o, 'iri' AS k, NULL AS d FROM n
UNION ALL SELECT s, 'http://e.org/key', n_nationkey::VARCHAR, 'literal', x || 'integer' FROM n, x UNION ALL SELECT s, 'http://e.org/at', 'http://r.org/' || n_regionkey, 'iri', NULL FROM n
UNION ALL SELECT s, 'http://e.org/label', n_name || ' / ' || n_regionkey, 'literal', NULL FROM n UNION ALL SELECT s, 'http://e.org/type', 'iao:dataset', 'iri', NULL FROM n
UNION ALL SELECT s, 'http://e.org/half', (n_regionkey / 2.0)::DOUBLE::VARCHAR, 'literal', x || 'double' FROM n, x WHERE n_regionkey > 1)
SELECT s AS subject, p AS predicate, o AS object, k AS object_kind, d AS datatype FROM q"""
)
def kg_terms(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("link", F.concat(F.lit("http://r.org/"), F.col("n_regionkey").cast("string")))
    return mapping.compile_mapping(spark, mapping.read_mapping(_TERMS), {"nation": nation}).drop("graph", "lang")


@query("SELECT 'http://e.org/' || i || '/' || c_custkey AS subject, 'http://e.org/p' || i AS predicate, c_name AS object FROM customer, range(120) AS r(i) WHERE c_custkey <= 50")
def kg_many_maps(spark, sf_dir):
    """120 maps of one table: one scan."""
    maps = "\n".join(f'<#M{i}> a rr:TriplesMap ; rr:logicalTable [ rr:tableName "customer" ] ; rr:subjectMap [ rr:template "http://e.org/{i}/{{c_custkey}}" ] ; rr:predicateObjectMap [ rr:predicate <http://e.org/p{i}> ; rr:objectMap [ rr:column "c_name" ] ] .' for i in range(120))
    rows = table(spark, sf_dir, "customer").where("c_custkey <= 50")
    quads = mapping.compile_mapping(spark, mapping.read_mapping("@prefix rr: <http://www.w3.org/ns/r2rml#> .\n" + maps), {"customer": rows})
    return quads.select("subject", "predicate", "object")


# ---- whole runs, with stand-ins for models ----


def _vowels(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often each vowel stands in a text, plus one."""
    return [[float(t.lower().count(v) + 1) for v in "aeiou"] for t in texts]


def _vector(c: str) -> str:
    return "[" + ", ".join(f"(1 + length({c}) - length(replace(lower({c}), '{v}', '')))::DOUBLE" for v in "aeiou") + "]"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.lit("part").alias("source"))


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


_GOALS = [("g1", "Goal A", "alpha banana data"), ("g2", "Goal E", "tree seed meter"), ("g3", "Goal I", "fish in mist"), ("g4", "Goal O", "wood soil root")]
_RUN = f"""WITH g AS (SELECT * FROM (VALUES {", ".join(repr(g) for g in _GOALS)}) AS v(gid, label, t)), p AS (SELECT p_partkey::VARCHAR AS id, p_name || ' ' || p_type AS t FROM part),
s AS (SELECT p.id, gid, label, list_cosine_similarity({_vector('p.t')}, {_vector('g.t')}) AS score FROM p CROSS JOIN g),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, gid) AS n FROM s), top AS (SELECT id, gid, label, score FROM r WHERE n = 1),
cuts AS (SELECT gid, CASE WHEN count(*) >= {{least}} THEN quantile_cont(score, 0.8) ELSE 0.25 END AS cut FROM top GROUP BY gid) """


@query(_RUN.format(least=10) + "SELECT id, gid AS goal1_id, label AS goal1_label FROM top")
def run_goals(spark, sf_dir):
    """Goals and documents to vectors, documents to goals; the default margin of 0 accepts all."""
    out = pipelines.classify(spark, _parts(spark, sf_dir), files.constants(spark, _GOALS), _vowels)
    return out["classified"].select("id", "goal1_id", "goal1_label")


@query(_RUN.format(least=20) + "SELECT gid AS id, label, count(*) AS n_docs FROM top GROUP BY gid, label")
def run_anchors(spark, sf_dir):
    return pipelines.embed_and_assign(spark, _parts(spark, sf_dir), files.constants(spark, _GOALS), _vowels)["summary"]


@query(_RUN.format(least=20) + "SELECT gid AS id, label, count(*) AS n_docs FROM top JOIN cuts USING (gid) WHERE round(score, 12) >= round(greatest(0.25, cut), 12) GROUP BY gid, label")
def run_anchors_adaptive(spark, sf_dir):
    return pipelines.embed_and_assign_adaptive(spark, _parts(spark, sf_dir), files.constants(spark, _GOALS), _vowels)["summary"]


@query()
def run_super_anchors(spark, sf_dir):
    anchors = _regions(spark, sf_dir).select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), F.concat_ws(" ", "n_name", "r_name").alias("text"))
    return pipelines.super_anchor_run(spark, _parts(spark, sf_dir), anchors, _vowels, k=5)["assigned"]


def _stub(system: str, user: str) -> str:
    """A stand-in for a model that has no answer to some prompts."""
    if "sentence" in user:
        raise RuntimeError("no answer")
    return ' "Stub", of course'


def _clustered(spark, sf_dir):
    rows = _regions(spark, sf_dir).select(F.col("n_nationkey").cast("string").alias("id"), F.concat_ws(" ", "n_name", "r_name").alias("text"), F.lit("nation").alias("source"))
    many = rows.unionByName(rows.withColumn("id", F.concat("id", F.lit("b")))).unionByName(rows.withColumn("id", F.concat("id", F.lit("c"))))
    return pipelines.embed_cluster_refine(spark, many, _vowels, _stub, min_cluster_size=3, min_df=1)


@query()
def run_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir)["topics"]


@query()
def run_clusters_refined(spark, sf_dir):
    return _clustered(spark, sf_dir)["refined"]


def _extractor(system: str, user: str) -> str:
    """A stand-in that reads the first line of the title."""
    title = user.split("\n")[1]
    if title.endswith("0") or title.endswith("5"):
        raise RuntimeError("no answer")
    return '```json\n{"review": ["Yes"], "number_of_ep": 3,}\n```'


@query("SELECT 'review' AS field, count(*) AS support, count(*) FILTER (doc_id % 5 <> 0 AND quality = 1) AS tp, count(*) FILTER (doc_id % 5 <> 0 AND quality <> 1) AS fp FROM labels")
def run_extraction(spark, sf_dir):
    """Prompts, answers, flat records and their scores."""
    labels = table(spark, sf_dir, "labels")
    publications = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("title"), F.lit("text").alias("abstract"))
    catalogue = spark.createDataFrame([("Review", "", "yes; no"), ("Number of EP", "", "integer")], "`category name` string, `category definition` string, `allowed answers` string")
    gold = labels.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("review"))
    out = pipelines.extract_and_evaluate(spark, publications, catalogue, _extractor, gold)
    return out["scores"].select("field", "support", "tp", "fp")
