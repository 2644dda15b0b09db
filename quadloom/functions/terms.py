"""RDF terms: constants in Python, and their physical forms in DataFrames.

A column of a solution holds one variable in one of these forms; null is unbound in each:

* ``term``: a struct (k, v, dt, lang) whose kind may differ by row,
* ``iri``: the text of an IRI,
* ``key``: an IRI with a constant beginning; the column holds what follows it in its native type,
* ``lit``: a literal of one constant datatype in its native type.

Native forms let equal templates join on their keys and literals compare, add and sort without a cast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TERM = T.StructType([T.StructField("k", T.ByteType()), T.StructField("v", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])
TERM_DDL = "struct<k:tinyint,v:string,dt:string,lang:string>"
INTEGERS = ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
NATIVE = {"xsd:integer": "bigint", "xsd:decimal": "decimal(38,18)", "xsd:double": "double", "xsd:float": "float", "xsd:boolean": "boolean", "xsd:string": "string", "xsd:dateTime": "timestamp_ntz", "xsd:date": "date"}


def compact_type(iri: str) -> str:
    """xsd:... for the XSD datatypes and rdf:langString; other IRIs as they are."""
    if iri.startswith(XSD):
        return "xsd:" + iri[len(XSD) :]
    return "rdf:langString" if iri == RDF + "langString" else iri


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = "xsd:string"
    lang: str | None = None


Term = IRI | BNode | Literal


def make(k: int | Column, v: Column, dt: Column | str | None = None, lang: Column | None = None) -> Column:
    as_col = lambda x: F.lit(x) if not isinstance(x, Column) else x
    return F.struct(as_col(k).cast("tinyint").alias("k"), v.alias("v"), as_col(dt).cast("string").alias("dt"), as_col(lang).cast("string").alias("lang"))


def constant(t: Term) -> Column:
    if isinstance(t, IRI):
        return make(1, F.lit(t.value))
    if isinstance(t, BNode):
        return make(0, F.lit(t.value))
    return make(2, F.lit(t.value), t.datatype, F.lit(t.lang))


def lexical(c: Column, datatype: str) -> Column:
    """Canonical lexical form of a native column."""
    if datatype in ("xsd:double", "xsd:float"):
        s = c.cast("string")
        return F.when(s == "Infinity", "INF").when(s == "-Infinity", "-INF").otherwise(s)
    if datatype == "xsd:decimal":
        s = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(s.rlike(r"^-?0+$"), "0").otherwise(s)
    if datatype == "xsd:dateTime":
        s = c.cast("timestamp_ntz").cast("string")
        return F.replace(s, F.lit(" "), F.lit("T"))
    return c.cast("string")


@dataclass(frozen=True)
class Form:
    """How a column holds its variable."""

    kind: str  # term iri key lit
    prefix: str = ""  # of a key
    datatype: str = ""  # of a literal

    def term(self, c: Column) -> Column:
        if self.kind == "term":
            return c
        if self.kind == "iri":
            out = make(1, c)
        elif self.kind == "key":
            out = make(1, F.concat(F.lit(self.prefix), c.cast("string")))
        else:
            out = make(2, lexical(c, self.datatype), self.datatype)
        return F.when(c.isNotNull(), out)

    def text(self, c: Column) -> Column:
        """STR of the term."""
        if self.kind == "term":
            return c["v"]
        if self.kind == "key":
            return F.concat(F.lit(self.prefix), c.cast("string"))
        return c if self.kind == "iri" else lexical(c, self.datatype)

    def equal(self, c: Column, t: Term) -> Column | None:
        """Condition that the column is the constant term; None if it never is."""
        if self.kind == "term":
            if isinstance(t, IRI):
                return (c["k"] == 1) & (c["v"] == t.value)
            if isinstance(t, BNode):
                return (c["k"] == 0) & (c["v"] == t.value)
            same = (c["k"] == 2) & (c["v"] == t.value) & (c["dt"] == t.datatype)
            return same & (c["lang"] == t.lang) if t.lang else same
        if self.kind == "iri":
            return c == t.value if isinstance(t, IRI) else None
        if self.kind == "key":
            if not isinstance(t, IRI) or not t.value.startswith(self.prefix):
                return None
            rest = t.value[len(self.prefix) :]
            return c.cast("string") == rest if not rest.lstrip("-").isdigit() else (c == F.lit(rest).try_cast("bigint")) & (c.cast("string") == rest)
        if not isinstance(t, Literal) or t.datatype != self.datatype:
            return None
        if self.datatype == "xsd:string":
            return c == t.value
        return (c == F.lit(t.value).try_cast(NATIVE.get(self.datatype, "string"))) & (self.text(c) == t.value)


TERMS = Form("term")
IRIS = Form("iri")


def lit_form(datatype: str) -> Form:
    return Form("lit", datatype=datatype)
