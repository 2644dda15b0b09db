"""Graphs that can be queried, and query results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.terms import IRI, IRIS, TERM_DDL, TERMS, XSD, Form, Term
from .plans.compiler import Compiler
from .plans.parser import parse
from .plans.solution import Solutions, column


@dataclass(frozen=True)
class Relation:
    """Statements in columns s, p, o, g of given forms; g is null in the default graph."""

    df: DataFrame
    forms: dict[str, Form]


@dataclass(frozen=True)
class Nodes:
    df: DataFrame  # node, g
    form: Form
    graph_form: Form


class Result:
    """A bag of solutions."""

    def __init__(self, solutions: Solutions):
        self.solutions = solutions
        self.names = list(solutions.vars)

    def terms(self) -> DataFrame:
        """One term column for each variable; null is unbound."""
        s = self.solutions
        return s.df.select(*[s.vars[n].form.term(F.col(column(n))).alias(n) for n in self.names])

    def native(self, **types: str) -> DataFrame:
        """Columns as Spark types (name="bigint", ...); others as the text of their term. What doesn't cast is null."""
        s = self.solutions
        out = []
        for n in self.names:
            form, c = s.vars[n].form, F.col(column(n))
            to = types.get(n, "string")
            if form.kind == "lit" and to != "string":
                c = c.try_cast(to)
            else:
                c = form.text(c)
                c = c if to == "string" else F.replace(c, F.lit("T"), F.lit(" ")).try_cast(to) if to.startswith("timestamp") else c.try_cast(to)
            out.append(c.alias(n))
        return s.df.select(*out)

    def json(self) -> DataFrame:
        """One JSON object a row: {variable: {value, dataType, language}}; unbound variables are left out, IRIs and blank nodes are xsd:anyURI."""
        fields = []
        for n in self.names:
            t = F.col(n)
            dt = F.when(t["k"] != 2, XSD + "anyURI").when(t["dt"].startswith("xsd:"), F.concat(F.lit(XSD), F.substring(t["dt"], 5, 1000))).when(t["dt"] == "rdf:langString", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(t["dt"])
            obj = F.struct(t["v"].alias("value"), dt.alias("dataType"), t["lang"].alias("language"))
            fields.append(F.when(t.isNotNull(), F.concat(F.to_json(F.struct(F.lit(n).alias("n"))).substr(F.lit(6), F.lit(len(n) + 2)), F.lit(":"), F.to_json(obj, {"ignoreNullFields": "false"}))))
        return self.terms().select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("value"))


class Queryable:
    spark = None

    def sparql(self, query: str, bindings: dict[str, Term] | None = None) -> Result:
        """Runs a SELECT or ASK query; bindings give variables fixed values."""
        return Result(Compiler(self, bindings).run(parse(query)))

    def evaluate(self, tree, bindings: dict[str, Term] | None = None) -> Result:
        """Runs a query that is parsed already."""
        return Result(Compiler(self, bindings).run(tree))


class Graph(Queryable):
    """Statements in a DataFrame s, p, o, g: terms (k, v, dt, lang), p the text of an IRI, g null in the default graph.

    Rows with a null s, p or o are no statements; other columns are ignored; repeated statements count as often as
    they occur unless ``dedup`` is set.
    """

    FORMS = {"s": TERMS, "p": IRIS, "o": TERMS, "g": TERMS}

    def __init__(self, quads: DataFrame, dedup: bool = False):
        self.spark = quads.sparkSession
        g = F.col("g").cast(TERM_DDL) if "g" in quads.columns else F.lit(None).cast(TERM_DDL)
        df = quads.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select(F.col("s").cast(TERM_DDL).alias("s"), "p", F.col("o").cast(TERM_DDL).alias("o"), g.alias("g"))
        self.quads = df.distinct() if dedup else df

    def _in(self, which) -> DataFrame:
        if which is None:
            return self.quads
        if which == "named":
            return self.quads.where("g IS NOT NULL")
        if not which:
            return self.quads.where(F.lit(False))
        g = F.col("g")
        return self.quads.where((g["k"] == 1) & g["v"].isin(which))

    def scan(self, p, which) -> list[Relation]:
        return [Relation(self._in(which), self.FORMS)]

    def nodes(self, which) -> Nodes:
        df = self._in(which)
        return Nodes(df.select(F.col("s").alias("node"), "g").union(df.select("o", "g")).distinct(), TERMS, TERMS)


@dataclass(frozen=True)
class Table:
    """How a relational table is seen as statements: its key, and columns that refer to other tables as {column: (predicate, table)}."""

    df: DataFrame
    key: tuple[str, ...]
    links: dict[str, tuple[str, str]]
    named: bool = True
    language: tuple[str, str] | None = None  # (text column, column of its language)


_DATATYPES = {"int": "xsd:integer", "bigint": "xsd:integer", "smallint": "xsd:integer", "tinyint": "xsd:integer", "double": "xsd:double", "float": "xsd:float", "string": "xsd:string", "boolean": "xsd:boolean", "timestamp_ntz": "xsd:dateTime", "timestamp": "xsd:dateTime", "date": "xsd:date"}


class MappedGraph(Queryable):
    """Relational tables as a virtual graph. Each column is a branch (subject by key, predicate by name, object in
    its native type); a pattern reads only the branches that its predicate can match, and keys stay numbers, so a
    join along a link is a join of key columns and only the used columns are read. A null cell is no statement."""

    def __init__(self, tables: dict[str, Table], base: str = "http://data.example/", ns: str = "http://data.example/ns#"):
        self.spark = next(iter(tables.values())).df.sparkSession
        self.tables, self.base, self.ns = tables, base, ns
        self.branches: list[tuple[str, str, dict[str, Form]]] = []
        self.exprs: dict[tuple[str, str], Column] = {}
        for name, t in tables.items():
            cols = [F.col(k) for k in t.key]
            s = cols[0].cast("bigint") if len(cols) == 1 else F.concat_ws("-", *[c.cast("string") for c in cols])
            self._add(name, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", t, s, F.lit(ns + name.capitalize()), IRIS)
            for f in t.df.schema.fields:
                kind = f.dataType.simpleString()
                if f.name in t.links:
                    p, to = t.links[f.name]
                    self._add(name, ns + p, t, s, F.col(f.name).cast("bigint"), Form("key", base + to + "/"))
                if t.language and f.name == t.language[0]:
                    lang = F.lower(F.col(t.language[1]))
                    o = F.when(F.col(f.name).isNotNull(), F.struct(F.lit(2).cast("tinyint").alias("k"), F.col(f.name).alias("v"), F.when(lang.isNull(), "xsd:string").otherwise("rdf:langString").alias("dt"), lang.alias("lang")))
                    self._add(name, ns + f.name, t, s, o, TERMS)
                elif kind in _DATATYPES:
                    c = F.col(f.name)
                    dt = _DATATYPES[kind]
                    o = c.cast("bigint") if dt == "xsd:integer" else c.cast("timestamp_ntz") if kind == "timestamp" else c
                    self._add(name, ns + f.name, t, s, o, Form("lit", datatype=dt))

    def _add(self, name: str, p: str, t: Table, s: Column, o: Column, form: Form) -> None:
        self.exprs[name, ""], self.exprs[name, p] = s, o
        self.branches.append((name, p, {"s": Form("key", self.base + name + "/"), "p": IRIS, "o": form, "g": Form("key", self.base + "graph/")}))

    def _relation(self, branch: tuple[str, str, dict[str, Form]]) -> Relation:
        name, p, forms = branch
        t = self.tables[name]
        g = F.lit(name) if t.named else F.lit(None).cast("string")
        df = t.df.select(self.exprs[name, ""].alias("s"), F.lit(p).alias("p"), self.exprs[name, p].alias("o"), g.alias("g"))
        return Relation(df.where("s IS NOT NULL AND o IS NOT NULL"), forms)

    def _visible(self, which) -> list[tuple[str, str, dict[str, Form]]]:
        if which is None:
            return self.branches
        named = {n for n, t in self.tables.items() if t.named}
        prefix = self.base + "graph/"
        return [b for b in self.branches if b[0] in named and (which == "named" or prefix + b[0] in which)]

    def scan(self, p, which) -> list[Relation]:
        some = self._visible(which)
        if isinstance(p, IRI):
            some = [b for b in some if b[1] == p.value]
        elif isinstance(p, list):
            some = [b for b in some if IRI(b[1]) in p]
        elif isinstance(p, tuple):
            some = [b for b in some if IRI(b[1]) not in p[1]]
        by: dict[str, list] = {}
        for b in some:
            by.setdefault(b[0], []).append(b)
        return [self._relation(bs[0]) if len(bs) == 1 else self._unpivoted(n, bs) for n, bs in by.items()]

    def _unpivoted(self, name: str, branches: list) -> Relation:
        """Several columns of a table by one scan of it."""
        t = self.tables[name]
        pairs = [F.struct(F.lit(p).alias("p"), forms["o"].term(self.exprs[name, p]).alias("o")) for _, p, forms in branches]
        g = F.lit(name) if t.named else F.lit(None).cast("string")
        df = t.df.select(self.exprs[name, ""].alias("s"), F.inline(F.array(*pairs)), g.alias("g"))
        return Relation(df.where("s IS NOT NULL AND o IS NOT NULL"), {**branches[0][2], "o": TERMS})

    def star(self, predicates: list[str], which) -> Relation | None:
        """Columns s, o0, o1, ... and g of one table for several predicates of one subject, if they are all columns of it alone; the key is unique, so this equals the join of the branches."""
        found = [[b for b in self._visible(which) if b[1] == p] for p in predicates]
        if any(len(f) != 1 for f in found) or len({f[0][0] for f in found}) != 1:
            return None
        name = found[0][0][0]
        t = self.tables[name]
        forms = {"s": found[0][0][2]["s"], "g": found[0][0][2]["g"]} | {f"o{i}": f[0][2]["o"] for i, f in enumerate(found)}
        cols = [self.exprs[name, p].alias(f"o{i}") for i, p in enumerate(predicates)]
        df = t.df.select(self.exprs[name, ""].alias("s"), *cols, (F.lit(name) if t.named else F.lit(None).cast("string")).alias("g"))
        return Relation(df.where(" AND ".join(f"{c} IS NOT NULL" for c in ["s", *(f"o{i}" for i in range(len(cols)))])), forms)

    def nodes(self, which) -> Nodes:
        out = None
        g = Form("key", self.base + "graph/")
        for r in self.scan(("not", []), which):
            for c in ("s", "o"):
                part = r.df.select(r.forms[c].term(F.col(c)).alias("node"), "g").distinct()
                out = part if out is None else out.union(part)
        if out is None:
            out = self.spark.range(0).select(F.lit(None).cast(TERM_DDL).alias("node"), F.lit(None).cast("string").alias("g"))
        return Nodes(out.distinct(), TERMS, g)
