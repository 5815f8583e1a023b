"""Queries on texts and tables: documents, scalars, topics, evaluation, model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stopwords, text
from ..operators import assign, ctfidf, evaluate, headers, records
from ..sources import files
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


# ---- documents, joins and lookups ----


@query("SELECT doc_id::VARCHAR AS id, text, 'documents' AS source FROM documents UNION ALL SELECT item_id::VARCHAR, text, 'benchmark' FROM benchmark")
def concat_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("merged"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("merged"))
    return files.documents([(docs, "data/documents.csv"), (items, "data/benchmark.csv")])


@query("SELECT doc_id::VARCHAR AS id, text, 'data/documents.csv' AS source FROM documents UNION ALL SELECT item_id::VARCHAR, text, 'data/benchmark.csv' FROM benchmark")
def concat_documents_cast(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("merged"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("merged"))
    return files.documents([(docs, "data/documents.csv"), (items, "data/benchmark.csv")], cast=True, base_names=False)


@query("SELECT user_id::VARCHAR AS user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) AS e WHERE n = 1")
def load_last_wins(spark, sf_dir):
    return evaluate.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM labels AS l LEFT JOIN documents AS d USING (doc_id)")
def align_left(spark, sf_dir):
    return assign.align(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT count(*) AS n FROM labels JOIN documents USING (doc_id)")
def align_strict_count(spark, sf_dir):
    return assign.align(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id", strict=True).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_nationkey, coalesce(n_name, s_nationkey::VARCHAR) AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) AS n ON s_nationkey = n_nationkey")
def label_lookup_default(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey <> 0")
    return assign.with_label(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), known, "s_nationkey", "n_nationkey", "n_name").select("s_suppkey", "s_nationkey", "label")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def key_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


# ---- scalars ----

#: What Python takes as white space, for DuckDB's regular expressions.
_BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = f"regexp_replace(translate(lower(regexp_replace({{x}}, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '’“”', '''\"\"'), '{_BLANK}+', ' ', 'g')"


def norm(x: str) -> str:
    return _NORM.replace("{x}", x)


def split_sql(x: str, ignored: bool = False) -> str:
    """Ordered distinct parts as a list: the first place of every value."""
    parts = f"list_filter(list_transform(regexp_split_to_array({x}, '{_BLANK}*[;,]{_BLANK}*'), lambda p: {norm('p')}), lambda p: p <> ''{' AND p NOT IN (' + ', '.join(repr(v) for v in text.IGNORED) + ')' if ignored else ''})"
    return f"list_filter({parts}, lambda v, i: list_position({parts}, v) = i)"


@query(f"SELECT doc_id, {norm('text')} AS normal FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_text(F.col("text")).alias("normal"))


_CELL = "replace(replace(p_name, ' ', ' ; '), 'a', ', ') || ', None; ' || p_brand || ' , ' || p_brand"


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("replace(replace(p_name, ' ', ' ; '), 'a', ', ') || ', None; ' || p_brand || ' , ' || p_brand").alias("cell"))


@query(f"SELECT p_partkey, array_to_string({split_sql('cell', True)}, '|') AS parts FROM (SELECT p_partkey, {_CELL} AS cell FROM part) AS c")
def split_multivalue_v1(spark, sf_dir):
    return _cells(spark, sf_dir).select("p_partkey", F.array_join(text.split_multivalue(F.col("cell"), True), "|").alias("parts"))


@query(f"SELECT p_partkey, array_to_string({split_sql('cell')}, '|') AS parts FROM (SELECT p_partkey, {_CELL} AS cell FROM part) AS c")
def split_multivalue_v2(spark, sf_dir):
    return _cells(spark, sf_dir).select("p_partkey", F.array_join(text.split_multivalue(F.col("cell")), "|").alias("parts"))


_ANSWER = "CASE quality WHEN 1 THEN CASE doc_id % 4 WHEN 0 THEN 'Yes; no' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' ELSE 'y' END ELSE CASE doc_id % 3 WHEN 0 THEN 'No' WHEN 1 THEN '0, 1' ELSE 'Maybe  So' END END"


@query(f"SELECT doc_id, CASE WHEN t IN ('yes', 'y', 'true', '1') OR (f IN ('yes', 'y', 'true', '1') AND t NOT IN ('no', 'n', 'false', '0')) THEN 'yes' WHEN t IN ('no', 'n', 'false', '0') OR f IN ('no', 'n', 'false', '0') THEN 'no' ELSE t END AS answer FROM (SELECT doc_id, t, list_extract(regexp_split_to_array(t, '\\s*[;,]\\s*'), 1) AS f FROM (SELECT doc_id, {norm('a')} AS t FROM (SELECT doc_id, {_ANSWER} AS a FROM labels) AS x) AS y) AS z")
def parse_yesno(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", text.parse_yesno(F.expr(_ANSWER)).alias("answer"))


@query(f"SELECT a.p_partkey, round(1 - levenshtein({norm('a.p_name')}, {norm('b.p_name')}) / greatest(length({norm('a.p_name')}), length({norm('b.p_name')}), 1), 6) AS sim FROM part AS a JOIN part AS b ON a.p_partkey + 1 = b.p_partkey")
def sim_ratio(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    b = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(text.sim_ratio(F.col("a"), F.col("b")), 6).alias("sim"))


def _neighbours(spark, sf_dir):
    words = lambda c: F.array_join(F.split(c, " "), "; ")
    a = table(spark, sf_dir, "part").select("p_partkey", words(F.col("p_name")).alias("p"))
    b = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), words(F.col("p_name")).alias("g"))
    return a.join(b, "p_partkey")


@query()
def fuzzy_match(spark, sf_dir):
    rows = _neighbours(spark, sf_dir).select("p_partkey", text.greedy_pairs(text.split_multivalue(F.col("p")), text.split_multivalue(F.col("g")), 0.5).alias("m"))
    return rows.select("p_partkey", F.size("m").alias("n"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x["sim"]), 6).alias("sims"))


@query()
def rouge_l(spark, sf_dir):
    rows = _neighbours(spark, sf_dir).select("p_partkey", text.rouge_l(F.replace("p", F.lit(";"), F.lit(" ")), F.replace("g", F.lit(";"), F.lit(" "))).alias("s"))
    return rows.select("p_partkey", *[F.round(F.col(f"s.{c}"), 6).alias(c) for c in ("p", "r", "f1")])


_KEY = "p_name || ' /' || p_type || ' (' || p_brand || ') – x_y'"


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(lower({_KEY}), '/', ' or '), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM part")
def normalize_key_v1(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_key(F.expr(_KEY)).alias("key"))


@query(f"SELECT p_partkey, replace(lower(regexp_replace(regexp_replace(translate(regexp_replace({_KEY}, '\\s+', ' ', 'g'), '/\\–—', '  --'), '[^0-9A-Za-z _-]+', '', 'g'), '^\\s+|\\s+$', '', 'g')), ' ', '_') AS key FROM part")
def normalize_key_v2(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_key_hyphen(F.expr(_KEY)).alias("key"))


_ALLOWED = "CASE p_partkey % 4 WHEN 0 THEN ' Integer ' WHEN 1 THEN '' ELSE '''' || replace(p_type, ' ', '; ') || ', ' || lower(p_type) || ', \"' || p_brand || '\"''' END"


@query(
    f"""WITH c AS (SELECT p_partkey, trim({_ALLOWED}) AS t FROM part),
s AS (SELECT p_partkey, t, list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '^''+|''+$', '', 'g'), '\\s*[;,]\\s*'), lambda p: trim(trim(trim(trim(p), ''''), '"'))), lambda p: p <> '') AS ps FROM c)
SELECT p_partkey, CASE WHEN lower(t) IN ('integer', 'int') THEN 'integer' WHEN len(ps) > 0 THEN 'string' END AS type, CASE WHEN lower(t) NOT IN ('integer', 'int') AND len(ps) > 0 THEN array_to_string(list_filter(ps, lambda v, i: list_position(list_transform(ps, lambda q: lower(q)), lower(v)) = i), '|') END AS enum FROM s"""
)
def allowed_answers(spark, sf_dir):
    a = text.allowed_answers(F.expr(_ALLOWED))
    return table(spark, sf_dir, "part").select("p_partkey", a["type"].alias("type"), F.array_join(a["enum"], "|").alias("enum"))


_MERGED = "CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Title: ' || lang || ' ' || source || chr(10) || 'Abstract: ' || text END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN regexp_matches(t, '(?is)title:\\s*.+') THEN regexp_extract(t, '(?is)title:\\s*(.+?)(\\n+|$)', 1) WHEN length(split_part(t, chr(10), 1)) <= 200 THEN trim(split_part(t, chr(10), 1)) ELSE '' END) ELSE lang || ' ' || source END AS title, CASE WHEN doc_id % 3 = 0 THEN trim(regexp_extract(t, '(?is)abstract:\\s*(.+)$', 1)) ELSE trim(text, ' ' || chr(10)) END AS abstract FROM (SELECT *, trim(text, ' ' || chr(10)) AS t FROM documents) AS d")
def title_abstract(spark, sf_dir):
    s = text.title_abstract(F.expr(_MERGED.replace("chr(10)", "char(10)")))
    return table(spark, sf_dir, "documents").select("doc_id", s["title"].alias("title"), s["abstract"].alias("abstract"))


_PATH = "'Metadata_generalType_' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '_') || 'Type_#text'"
_TITLE = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(
    f"""WITH p AS (SELECT DISTINCT {_PATH} AS path FROM part), w AS (SELECT path, list_filter(list_transform(string_split(regexp_replace(path, '_#text$', ''), '_'), lambda w: regexp_replace(w, '(type|status)$', '', 'i')), lambda w: w <> '' AND lower(w) NOT IN ('metadata', 'general')) AS ws FROM p),
d AS (SELECT path, list_filter(ws, lambda w, i: list_position(list_transform(ws, lambda v: lower(v)), lower(w)) = i) AS ds FROM w)
SELECT path, {_TITLE.replace('{x}', "replace(regexp_replace(path, '_#text$', ''), '_', ' ')")} AS simple, {_TITLE.replace('{x}', "array_to_string(list_slice(ds, greatest(len(ds) - 3, 1), len(ds)), ' ')")} AS short FROM d"""
)
def header_simplify(spark, sf_dir):
    """The simplified headers of every part name read as a tree path."""
    path = F.concat(F.lit("Metadata_generalType_"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("_")), F.lit("Type_#text"))
    paths = table(spark, sf_dir, "part").select(path.alias("path")).distinct()
    return paths.select("path", headers.simple_header_column(F.col("path")).alias("simple"), headers.short_header_column(F.col("path")).alias("short"))


# ---- topics ----

_LETTERS = r"[\p{L}\p{N}_]"


def _tfidf_sql(cls: str, first: str, rest: str, least: int, also: str, stop: list[str], ngram: int, min_df: str, top: int, tail: str) -> str:
    words = "', '".join(w.replace("'", "''") for w in stop)
    ahead = lambda n: " || ' ' || ".join(["t", *[f"lead(t, {j}) OVER w" for j in range(1, n)]])
    grams = " UNION ALL ".join(f"SELECT class, {ahead(n)} AS term FROM toks" + (" WINDOW w AS (PARTITION BY class ORDER BY doc_id, i)" if n > 1 else "") for n in range(1, ngram + 1))
    return f"""WITH raw AS (SELECT {cls} AS class, doc_id, unnest(regexp_extract_all(lower(text), '{first}{rest}')) AS t, unnest(range(len(regexp_extract_all(lower(text), '{first}{rest}')))) AS i FROM documents WHERE text IS NOT NULL),
toks AS (SELECT class, doc_id, i, t FROM raw WHERE {also}length(t) >= {least} AND t NOT IN ('{words}')),
n AS (SELECT class, term, count(*) AS n FROM ({grams}) AS g WHERE term IS NOT NULL GROUP BY class, term),
k AS (SELECT count(DISTINCT {cls}) AS k FROM documents),
df AS (SELECT term, count(*) AS df FROM n GROUP BY term HAVING count(*) >= {min_df}),
tf AS (SELECT class, term, n / sum(n) OVER (PARTITION BY class) AS tf FROM n JOIN df USING (term)),
grid AS (SELECT c.class, df.term, df.df FROM df CROSS JOIN (SELECT DISTINCT {cls} AS class FROM documents) AS c),
scored AS (SELECT g.class, g.term, coalesce(tf.tf * ln(k.k / (1 + g.df)), 0) AS score FROM grid AS g CROSS JOIN k LEFT JOIN tf ON tf.class = g.class AND tf.term = g.term),
ranked AS (SELECT class, term, score, row_number() OVER (PARTITION BY class ORDER BY round(score, 12) DESC, term) AS rank FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= {top})
{tail}"""


_SHOW = "SELECT class, term, round(score, 6) AS score, rank::INTEGER AS rank FROM top"


def _shown(terms):
    return terms.select("class", "term", F.round("score", 6).alias("score"), "rank")


@query(_tfidf_sql("source", _LETTERS, _LETTERS + "+", 2, "", [""], 3, "5", 10, _SHOW))
def ctfidf_base(spark, sf_dir):
    return _shown(ctfidf.class_tfidf(table(spark, sf_dir, "documents"), cls="source", text="text"))


@query(_tfidf_sql("source", r"[\p{L}\p{N}_][\p{L}\p{N}_\-]*[\p{L}\p{N}_]", "", 3, "regexp_matches(t, '^\\p{L}') AND ", stopwords.union(), 3, "5", 10, _SHOW))
def ctfidf_stop(spark, sf_dir):
    return _shown(ctfidf.class_tfidf(table(spark, sf_dir, "documents"), cls="source", text="text", pattern=ctfidf.PATTERN_ANCHOR, stop=stopwords.union()))


@query(_tfidf_sql("lang", _LETTERS, _LETTERS + "+", 2, "", stopwords.union(domain=stopwords.DOMAIN_BASED), 3, "least(5, (SELECT k FROM k))", 12, _SHOW))
def ctfidf_capped(spark, sf_dir):
    return _shown(ctfidf.class_tfidf(table(spark, sf_dir, "documents"), cls="lang", text="text", stop=stopwords.union(domain=stopwords.DOMAIN_BASED), top_k=12, k_policy="non_empty", cap_min_df=True))


_REFINER = stopwords.union(extra=",".join(stopwords.REFINER_EXTRA), domain=[])


@query(_tfidf_sql("source", _LETTERS, _LETTERS + "+", 2, "", _REFINER, 1, "3", 20, _SHOW))
def ctfidf_unigram(spark, sf_dir):
    return _shown(ctfidf.class_tfidf(table(spark, sf_dir, "documents"), cls="source", text="text", stop=_REFINER, ngram_max=1, min_df=3, top_k=20))


def _topics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = ctfidf.class_tfidf(docs, cls="source", text="text", stop=_REFINER, ngram_max=1, min_df=3, top_k=20)
    return docs, terms


_TOPIC = ", t AS (SELECT class, string_agg(term, '; ' ORDER BY rank) AS top_terms FROM top GROUP BY class), d AS (SELECT source AS class, count(*) AS n_docs FROM documents GROUP BY source), kw AS (SELECT class, coalesce(arg_min(CASE WHEN regexp_full_match(term, '\\p{L}{3,}') THEN term END, CASE WHEN regexp_full_match(term, '\\p{L}{3,}') THEN rank END), arg_min(term, rank)) AS keyword FROM top GROUP BY class) "


def _with(sql: str) -> str:
    return _tfidf_sql("source", _LETTERS, _LETTERS + "+", 2, "", _REFINER, 1, "3", 20, "SELECT 1").removesuffix("\nSELECT 1") + sql


@query(_with(_TOPIC + "SELECT class, n_docs, coalesce(top_terms, '') AS top_terms FROM d LEFT JOIN t USING (class)"))
def topic_table(spark, sf_dir):
    docs, terms = _topics(spark, sf_dir)
    return ctfidf.topic_table(docs, terms, cls="source")


@query(_with(_TOPIC + "SELECT class, keyword FROM kw"))
def topic_keyword(spark, sf_dir):
    return ctfidf.keyword(_topics(spark, sf_dir)[1], _REFINER)


@query(_with(_TOPIC + ", s AS (SELECT class, n_docs, keyword, list_slice(string_split(top_terms, '; '), 1, 6) AS seeds FROM d JOIN t USING (class) JOIN kw USING (class)), w AS (SELECT *, CASE WHEN list_contains(seeds, keyword) THEN seeds ELSE list_slice(list_prepend(keyword, seeds), 1, 6) END AS ts FROM s) SELECT class, n_docs, keyword, 'This cluster focuses on ' || array_to_string(list_slice(ts, 1, len(ts) - 1), ', ') || ', and ' || ts[len(ts)] || '.' AS sentence FROM w"))
def topic_sentence(spark, sf_dir):
    docs, terms = _topics(spark, sf_dir)
    return ctfidf.refine(ctfidf.topic_table(docs, terms, cls="source"), ctfidf.keyword(terms, _REFINER))


# ---- evaluation ----


@query("WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels) SELECT 'toxic' AS field, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c")
def confusion_prf(spark, sf_dir):
    cells = table(spark, sf_dir, "labels").select(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("p"), F.col("quality").cast("string").alias("g"))
    return evaluate.yesno(cells).select("field", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


_SETS = "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders"


def _multi_cells(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    p = F.expr("o_orderstatus || '; ' || (o_orderkey % 3) || ', ' || o_orderpriority")
    g = F.expr("o_orderstatus || ', ' || (o_orderkey % 2) || '; ' || o_orderpriority")
    return orders.select(F.lit("tags").alias("field"), p.alias("p"), g.alias("g"))


@query(
    """WITH r AS (SELECT CASE WHEN o_orderkey % 3 = o_orderkey % 2 THEN 3 ELSE 2 END AS i, CASE WHEN o_orderkey % 3 = o_orderkey % 2 THEN 0 ELSE 1 END AS d FROM orders),
s AS (SELECT sum(i) AS tp, sum(d) AS x, avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) AS subset_accuracy, avg(i / (i + 2 * d)) AS avg_jaccard, count(*) AS support FROM r)
SELECT 'tags' AS field, support, round(tp / (tp + x), 6) AS micro_precision, round(tp / (tp + x), 6) AS micro_recall, round(tp / (tp + x), 6) AS micro_f1, round(subset_accuracy, 6) AS subset_accuracy, round(avg_jaccard, 6) AS avg_jaccard FROM s"""
)
def multilabel_metrics(spark, sf_dir):
    scored = evaluate.multilabel(_multi_cells(spark, sf_dir))
    return scored.select("field", "support", *[F.round(c, 6).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "subset_accuracy", "avg_jaccard")])


@query(
    """WITH r AS (SELECT trunc(l_quantity)::BIGINT AS p, p_size AS g FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'size' AS field, count(*) AS support, round(avg(CASE WHEN p = g THEN 1.0 ELSE 0.0 END), 6) AS exact_match, round(avg(abs(p - g)), 6) AS mae, round(sqrt(avg((p - g) * (p - g))), 6) AS rmse FROM r"""
)
def numeric_metrics(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    cells = joined.select(F.lit("size").alias("field"), F.col("l_quantity").cast("string").alias("p"), F.col("p_size").cast("string").alias("g"))
    return evaluate.numeric(cells).select("field", "support", *[F.round(c, 6).alias(c) for c in ("exact_match", "mae", "rmse")])


@query()
def eval_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    pred = labels.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "Yes").otherwise("no").alias("review"), (F.col("doc_id") % 7).cast("string").alias("number_of_ep"), F.expr("'a; b' || (doc_id % 3)").alias("keywords"), F.lit("spring sampling").alias("study_design"))
    gold = labels.select(F.col("doc_id").cast("string").alias("Id"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("review"), (F.col("doc_id") % 5).cast("string").alias("number_of_ep"), F.expr("'b' || (doc_id % 2) || ', a'").alias("keywords"), F.lit("spring samplings").alias("study_design"))
    scored = evaluate.evaluate(pred, gold)
    return scored.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in scored.dtypes])


# ---- model output ----


def _answers(spark, sf_dir):
    """Model answers about events, fenced and with trailing commas now and then."""
    raw = F.expr("case event_id % 4 when 0 then '```json\\n' || regexp_replace(props, '}$', ',}') || '\\n```' when 1 then props when 2 then '{\"review\": [\"x\", \"No\"], \"field\": true, \"n\": [1, null, \"b\"], \"forest\": \"maybe\"}' else 'no json' end")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "props", raw.alias("raw"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 'not a JSON object' END AS error FROM events")
def lenient_json(spark, sf_dir):
    return records.parse_records(_answers(spark, sf_dir), "raw").select("id", "error")


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 2 THEN 'no' ELSE '' END AS review, CASE WHEN event_id % 4 = 2 THEN 'yes' ELSE '' END AS field, '' AS forest, CASE WHEN event_id % 4 = 2 THEN '1; b' ELSE '' END AS n, CASE WHEN event_id % 4 IN (0, 1) THEN coalesce(json_extract_string(props, '$.' || (json_keys(props))[1]), '') ELSE '' END AS first_key FROM events")
def flatten_record(spark, sf_dir):
    parsed = records.parse_records(_answers(spark, sf_dir), "raw")
    key = records.record_keys(records.parse_records(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("raw")), "raw"))[0]
    return records.flatten_records(parsed, ["review", "field", "forest", "n", key]).withColumnRenamed(key, "first_key").drop("error")


@query("SELECT DISTINCT k FROM (SELECT unnest(json_keys(props)) AS k FROM events) AS e")
def json_key_union(spark, sf_dir):
    keys = records.record_keys(records.parse_records(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("raw")), "raw"))
    return spark.createDataFrame([(k,) for k in keys], "k string")


_VALUES = "case l_orderkey % 6 when 0 then 'true' when 1 then '0' when 2 then '[\"x\", \"No\"]' when 3 then '[\"x\", null]' when 4 then '\" YES \"' else '\"x\"' end"


@query("SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'no' WHEN 3 THEN 'x; ' WHEN 4 THEN 'yes' ELSE '' END AS answer FROM lineitem")
def to_yes_no(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", records.to_yes_no(F.try_parse_json(F.expr(_VALUES))).alias("answer"))


def _catalogue(spark):
    rows = [("Role / Kind", "who speaks", "user; assistant, system"), ("Turns", "how many", "integer"), ("Free", "", "")]
    return spark.createDataFrame(rows, "`category name` string, `category definition` string, `allowed answers` string")


@query("SELECT conv_id, turn, 'TITLE:' || chr(10) || role || chr(10) || chr(10) || 'ABSTRACT:' || chr(10) || text || chr(10) || chr(10) || 'Now produce ONLY the JSON object with fields as per the schema keys above.' AS user_prompt FROM conversations")
def prompt_build(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.col("text").alias("abstract"))
    return records.prompts(rows, records.build_schema(_catalogue(spark), "conversations")).select("conv_id", "turn", "user_prompt")


@query("SELECT conv_id, turn, (role IN ('user', 'assistant', 'system') AND turn % 5 <> 4) AS valid, CASE WHEN role IN ('user', 'assistant', 'system') AND turn % 5 <> 4 THEN '{\"role_or_kind\": [\"' || role || '\"], \"turns\": ' || turn || '}' END AS prediction FROM conversations")
def validate_record(spark, sf_dir):
    schema = records.build_schema(_catalogue(spark), "conversations")
    raw = F.expr("'```json\\n{\"role_or_kind\": \"' || upper(role) || '\", \"turns\": ' || turn || case when turn % 5 = 4 then ', \"other\": 1' else '' end || '}\\n```'")
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), raw.alias("raw"))
    return records.validate(rows, "raw", schema).select("id.conv_id", "id.turn", "valid", "prediction")


def _stub_model(system: str, user: str) -> str:
    """A fixed stand-in for a model: fails on some rows, answers with the length of the prompt on others."""
    if len(user) % 7 == 0:
        raise RuntimeError("no answer")
    return f'{{"length": {len(user)}}}'


@query("SELECT conv_id, turn, CASE WHEN n % 7 <> 0 THEN '{\"length\": ' || n || '}' END AS raw, CASE WHEN n % 7 = 0 THEN 'RuntimeError: no answer' END AS error FROM (SELECT conv_id, turn, length('TITLE:' || role || text) AS n FROM conversations) AS c")
def infer_stub(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.lit("").alias("system_prompt"), F.concat(F.lit("TITLE:"), "role", "text").alias("user_prompt"))
    keyed = rows.withColumn("key", F.to_json("id"))
    done = records.infer(keyed, _stub_model, key="key")
    parts = F.from_json("key", "conv_id long, turn long")
    return done.select(parts["conv_id"].alias("conv_id"), parts["turn"].alias("turn"), "raw", "error")
