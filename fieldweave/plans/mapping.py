"""Declarative relational-to-graph mappings: model, Turtle reader and compiler to DataFrames.

A mapping (W3C R2RML) says how rows of logical tables become quads.  All maps of one
logical table compile to one scan: each row yields an array of quad structs, exploded
once, in chunks small enough for generated code.  A template with a NULL column is NULL,
which drops the term and every quad it is part of.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iri_safe
from ..operators.joins import distinct

RR = "http://www.w3.org/ns/r2rml#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: Quads built in one array expression.
CHUNK = 96


@dataclass(frozen=True)
class Term:
    """A term map: one of constant, template, column or parent (the subject of another map)."""

    constant: str | None = None
    template: str | None = None
    column: str | None = None
    parent: str | None = None
    kind: str | None = None  # iri or literal
    language: str | None = None
    datatype: str | None = None


@dataclass
class PredicateObject:
    predicates: list[Term] = field(default_factory=list)
    objects: list[Term] = field(default_factory=list)
    graphs: list[Term] = field(default_factory=list)


@dataclass
class TriplesMap:
    name: str
    table: str | None = None
    query: str | None = None
    subject: Term | None = None
    classes: list[str] = field(default_factory=list)
    graphs: list[Term] = field(default_factory=list)
    properties: list[PredicateObject] = field(default_factory=list)


# ---- Turtle, as far as mappings use it ----

_TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<iri><[^>\n]*>)|(?P<lang>@[A-Za-z][A-Za-z0-9\-]*)|(?P<type>\^\^)|(?P<punct>[\[\](),;]|\.(?=\s|$|\]))|(?P<name>[A-Za-z_][\w\-]*?:[\w\-.%{}/:]*[\w\-%{}/]|[A-Za-z_][\w\-]*:|:[\w\-]+|\ba\b|true|false|[+-]?\d+(?:\.\d+)?)',
    re.UNICODE,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "'": "'"}


def _tokens(text: str):
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable Turtle at {text[at : at + 40]!r}")
        if m.lastgroup:
            yield m.lastgroup, m[0]
        at = m.end()


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), s)


class _Reader:
    """Subjects with their (predicate, object) lists; blank nodes are nested lists."""

    def __init__(self, text: str):
        self.items = list(_tokens(text))
        self.at = 0
        self.prefixes: dict[str, str] = {}

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.items[self.at - 1]

    def expect(self, mark: str) -> None:
        if self.take()[1] != mark:
            raise ValueError(f"expected {mark!r} before {self.items[self.at : self.at + 3]}")

    def resolve(self, kind: str, value: str):
        if kind == "iri":
            return ("iri", value[1:-1])
        if value == "a":
            return ("iri", RDF_TYPE)
        if re.fullmatch(r"[+-]?\d+(\.\d+)?|true|false", value):
            return ("literal", value, None, None)
        prefix, _, rest = value.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return ("iri", self.prefixes[prefix] + rest)

    def node(self):
        kind, value = self.take()
        if value == "[":
            pairs = [] if self.peek()[1] == "]" else self.pairs()
            self.expect("]")
            return ("node", pairs)
        if kind in ("string", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            language = datatype = None
            if self.peek()[0] == "lang":
                language = self.take()[1][1:]
            elif self.peek()[0] == "type":
                self.take()
                datatype = self.resolve(*self.take())[1]
            return ("literal", text, language, datatype)
        return self.resolve(kind, value)

    def pairs(self) -> list:
        out = []
        while True:
            predicate = self.resolve(*self.take())[1]
            out.append((predicate, self.node()))
            while self.peek()[1] == ",":
                self.take()
                out.append((predicate, self.node()))
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return out

    def read(self) -> list:
        out = []
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if kind == "lang" and value in ("@prefix", "@base"):
                self.take()
                if value == "@prefix":
                    name = self.take()[1]
                    self.prefixes[name.removesuffix(":")] = self.take()[1][1:-1]
                else:
                    self.take()
                self.expect(".")
                continue
            subject = self.node()
            pairs = self.pairs()
            if self.peek()[1] == ".":
                self.take()
            out.append((subject, pairs))
        return out


def read_turtle(text: str) -> list:
    """[(subject, [(predicate, object)])]; objects are ("iri", v), ("literal", v, language, datatype) or ("node", pairs)."""
    return _Reader(text).read()


def triples(text: str):
    """Plain (subject, predicate, object) triples of a document without blank nodes."""
    for subject, pairs in read_turtle(text):
        for predicate, value in pairs:
            if value[0] == "node":
                raise ValueError("blank nodes aren't plain triples")
            yield subject[1], predicate, value


def _value(pairs: list, name: str):
    return next((v for p, v in pairs if p == RR + name), None)


def _values(pairs: list, *names: str) -> list:
    return [v for p, v in pairs if p in [RR + n for n in names]]


def _term(value, default_kind: str) -> Term:
    """A term map node, or the shortcut of a constant."""
    if value[0] == "iri":
        return Term(constant=value[1], kind="iri")
    if value[0] == "literal":
        return Term(constant=value[1], kind="literal", language=value[2], datatype=value[3])
    pairs = value[1]
    parent, constant, template, column = (_value(pairs, n) for n in ("parentTriplesMap", "constant", "template", "column"))
    if parent is not None:
        return Term(parent=parent[1], kind="iri")
    language, datatype, kind = _value(pairs, "language"), _value(pairs, "datatype"), _value(pairs, "termType")
    named = None if kind is None else ("iri" if kind[1].endswith("IRI") else "literal" if kind[1].endswith("Literal") else "blank")
    if constant is not None:
        return _term(constant, default_kind)
    if template is not None:
        named = named or ("literal" if language or datatype else "iri")
        return Term(template=template[1], kind=named, language=language and language[1], datatype=datatype and datatype[1])
    if column is not None:
        return Term(column=column[1].strip('"'), kind=named or default_kind, language=language and language[1], datatype=datatype and datatype[1])
    raise ValueError("a term map without a value")


def read_mapping(text: str) -> list[TriplesMap]:
    """The triples maps of a mapping document, in order."""
    maps = []
    for subject, pairs in read_turtle(text):
        table = _value(pairs, "logicalTable")
        if table is None:
            continue
        m = TriplesMap(subject[1])
        name, query = _value(table[1], "tableName"), _value(table[1], "sqlQuery")
        m.table, m.query = name and name[1].strip('"'), query and query[1]
        made = _value(pairs, "subjectMap")
        if made is not None:
            m.subject = _term(made, "iri")
            m.classes = [v[1] for v in _values(made[1], "class")] if made[0] == "node" else []
            m.graphs = [_term(v, "iri") for v in _values(made[1], "graphMap", "graph")] if made[0] == "node" else []
        elif (short := _value(pairs, "subject")) is not None:
            m.subject = _term(short, "iri")
        for value in _values(pairs, "predicateObjectMap"):
            inner = value[1]
            m.properties.append(
                PredicateObject(
                    [_term(v, "iri") for v in _values(inner, "predicate", "predicateMap")],
                    [_term(v, "literal") for v in _values(inner, "object", "objectMap")],
                    list(dict.fromkeys(_term(v, "iri") for v in _values(inner, "graph", "graphMap"))),
                )
            )
        maps.append(m)
    return maps


# ---- compiling ----

_PART = re.compile(r"\{([^{}]+)\}")

# Natural datatypes of column types.
XSD = "http://www.w3.org/2001/XMLSchema#"
NATURAL = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "decimal": "decimal", "float": "double", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "binary": "hexBinary"}


def template_columns(template: str) -> list[str]:
    return _PART.findall(template)


class Compiler:
    """Term maps to expressions over the columns of one logical table."""

    def __init__(self, maps: list[TriplesMap], columns: list[tuple[str, str]]):
        """columns: (name, type) of the table's columns."""
        self.subjects = {m.name: m.subject for m in maps}
        self.columns = {c.lower(): c for c, _ in columns}
        self.types = {c.lower(): t for c, t in columns}

    def column(self, name: str) -> Column | None:
        known = self.columns.get(name.strip('"').lower())
        return None if known is None else F.col(f"`{known}`").cast("string")

    def value(self, term: Term) -> Column | None:
        """The term's text, or None where it can't exist (an unknown column)."""
        if term.parent is not None:
            parent = self.subjects.get(term.parent)
            return None if parent is None else self.value(parent)
        if term.constant is not None:
            return F.lit(term.constant)
        if term.column is not None:
            return self.column(term.column)
        parts: list[Column] = []
        at = 0
        for m in _PART.finditer(term.template):
            if m.start() > at:
                parts.append(F.lit(term.template[at : m.start()]))
            c = self.column(m[1])
            if c is None:
                return None
            parts.append(iri_safe(c) if term.kind == "iri" else c)
            at = m.end()
        if at < len(term.template) or not parts:
            parts.append(F.lit(term.template[at:]))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def datatype(self, term: Term) -> str | None:
        """The term's datatype: as given, else the natural one of its column's type."""
        if term.datatype or term.column is None or term.language or self.kind(term) != "literal":
            return term.datatype
        kind = self.types.get(term.column.strip('"').lower(), "").split("(")[0]
        return XSD + NATURAL[kind] if kind in NATURAL else None

    def kind(self, term: Term) -> str:
        return "iri" if term.parent is not None else term.kind or "iri"

    def constant(self, term: Term) -> bool:
        if term.parent is not None:
            return self.constant(self.subjects[term.parent])
        return term.constant is not None or term.template is not None and not template_columns(term.template)

    def quads(self, m: TriplesMap) -> list[tuple[Column, bool]]:
        """(quad struct or NULL, whether it is the same for every row) of a map."""
        out = []
        default = Term(constant="", kind="iri")

        def add(predicate: Term, obj: Term, graph: Term) -> None:
            terms = [m.subject, predicate, obj, graph]
            values = [self.value(t) for t in terms]
            if any(v is None for v in values):
                return
            s, p, o, g = values
            quad = F.struct(g.alias("graph"), s.alias("subject"), p.alias("predicate"), o.alias("object"), F.lit(self.kind(obj)).alias("object_kind"), F.lit(obj.language).cast("string").alias("lang"), F.lit(self.datatype(obj)).cast("string").alias("datatype"))
            there = [v.isNotNull() for v, t in zip(values, terms, strict=True) if not self.constant(t)]
            whole = quad
            if there:
                ok = there[0]
                for c in there[1:]:
                    ok = ok & c
                whole = F.when(ok, quad)
            out.append((whole, not there))

        for c in m.classes:
            for g in m.graphs or [default]:
                add(Term(constant=RDF_TYPE, kind="iri"), Term(constant=c, kind="iri"), g)
        for pom in m.properties:
            graphs = list(dict.fromkeys([*m.graphs, *pom.graphs])) or [default]
            for p in pom.predicates:
                for o in pom.objects:
                    for g in graphs:
                        add(p, o, g)
        return out


QUAD = ["graph", "subject", "predicate", "object", "object_kind", "lang", "datatype"]


def _of_table(table: DataFrame, maps: list[TriplesMap], all_maps: list[TriplesMap]) -> DataFrame | None:
    compiler = Compiler(all_maps, table.dtypes)
    found = [q for m in maps if m.subject is not None for q in compiler.quads(m)]
    varying, fixed = [q for q, same in found if not same], [q for q, same in found if same]
    parts = [table.select(F.explode(F.array_compact(F.array(*varying[i : i + CHUNK]))).alias("q")).select("q.*") for i in range(0, len(varying), CHUNK)]
    one = table.limit(1)  # the same quads for every row: once, if there is a row
    parts += [one.select(F.explode(F.array(*fixed[i : i + CHUNK])).alias("q")).select("q.*") for i in range(0, len(fixed), CHUNK)]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def compile_mapping(spark: SparkSession, maps: list[TriplesMap], tables: dict[str, DataFrame], queries: dict[str, DataFrame] | None = None) -> DataFrame:
    """The distinct quads of all maps over the given tables.

    ``queries`` gives DataFrames for SQL logical tables by map name; others run as Spark
    SQL over the tables.
    """
    groups: dict[tuple, list[TriplesMap]] = {}
    for m in maps:
        groups.setdefault(("table", m.table) if m.table else ("query", m.name), []).append(m)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = None
    for (kind, name), members in groups.items():
        table = tables[name] if kind == "table" else (queries or {}).get(name) if (queries or {}).get(name) is not None else spark.sql(members[0].query)
        part = _of_table(table, members, maps)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return distinct(out.select(*QUAD))


def turtle(quads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One Turtle statement a subject, in the column ``value``: its predicates and objects in order, whatever the graph."""
    lines = n_quads(quads.withColumn("graph", F.lit("")), [*(keep or []), "subject"])
    rows = lines.withColumn("pair", F.regexp_replace("value", r"^<[^>]*> | \.$", ""))
    whole = F.concat(F.lit("<"), F.col("subject"), F.lit("> "), F.array_join(F.array_sort(F.collect_set("pair")), " ;\n    "), F.lit(" ."))
    return rows.groupBy(*(keep or []), "subject").agg(whole.alias("value")).drop("subject")


def n_quads(quads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One N-Quads line a quad, in the column ``value``, with kept columns before it."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    literal = F.concat(F.lit('"'), escape(F.col("object")), F.lit('"'), F.coalesce(F.concat(F.lit("@"), F.col("lang")), F.concat(F.lit("^^"), iri(F.col("datatype"))), F.lit("")))
    obj = F.when(F.col("object_kind") == "iri", iri(F.col("object"))).otherwise(literal)
    graph = F.when(F.col("graph") != "", F.concat(F.lit(" "), iri(F.col("graph")))).otherwise("")
    return quads.select(*(keep or []), F.concat(iri(F.col("subject")), F.lit(" "), iri(F.col("predicate")), F.lit(" "), obj, graph, F.lit(" .")).alias("value"))
