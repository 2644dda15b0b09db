"""RDF files: Turtle, TriG, N-Triples, N-Quads and RDF/XML, plain or compressed by gzip or bzip2.

Line formats are read by ``spark.read.text`` (splittable, any file system) and the structural line parser; documents
of the other formats are parsed whole, one row of ``binaryFile`` each. A literal whose text isn't valid in its datatype
is a term all the same. The data source "rdf" offers the same
parsers, one partition a file. Blank nodes are scoped by file.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote, urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.terms import RDF, TERM, compact_type
from ..operators.rejects import KINDS, VALID, parse_columns, parse_lines
from ..plans.parser import unescape_string

QUADS = T.StructType([T.StructField("s", TERM), T.StructField("p", T.StringType()), T.StructField("o", TERM), T.StructField("g", TERM)])
FORMATS = {"nt": "lines", "nq": "lines", "ttl": "turtle", "trig": "turtle", "n3": "turtle", "rdf": "xml", "owl": "xml", "xml": "xml"}
_EXTENSION = re.compile(r"\.([A-Za-z0-9]+?)(?:\.(?:gz|bz2))?$")


class RdfSyntaxError(ValueError):
    """A file can't be parsed."""


def format_of(path: str) -> str | None:
    """lines, turtle or xml by the file's extension; None if it is unknown."""
    m = _EXTENSION.search(path)
    return FORMATS.get(m[1].lower()) if m else None


def unpack(data: bytes, path: str) -> bytes:
    return gzip.decompress(data) if path.endswith(".gz") else bz2.decompress(data) if path.endswith(".bz2") else data


def _term(k: int, v: str, dt: str | None = None, lang: str | None = None) -> dict:
    return {"k": k, "v": v, "dt": dt, "lang": lang}


_TTL = re.compile(
    r"""(?P<ws>\s+|\#[^\n\r]*)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<bnode>_:\w(?:[\w.\-·]*[\w\-·])?)
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<pname>(?:[^\W\d_](?:[\w\-.·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w\-.:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<op>\^\^|[\[\](){}.;,])""",
    re.X | re.S,
)


class _Turtle:
    """Turtle and TriG."""

    def __init__(self, text: str, scope: str, base: str = ""):
        self.text, self.scope, self.base = text, scope, base
        self.prefixes: dict[str, str] = {}
        self.at, self.fresh = 0, 0
        self.graph: dict | None = None
        self.out: list[tuple] = []
        self.kind, self.tok = "", ""
        self.step()

    def step(self) -> str:
        last = self.tok
        while True:
            if self.at >= len(self.text):
                self.kind, self.tok = "end", ""
                return last
            m = _TTL.match(self.text, self.at)
            if not m:
                raise RdfSyntaxError(f"can't read {self.text[self.at : self.at + 40]!r} at {self.at}")
            self.at = m.end()
            if m.lastgroup != "ws":
                self.kind, self.tok = m.lastgroup, m[0]
                return last

    def need(self, tok: str) -> None:
        if self.tok != tok:
            raise RdfSyntaxError(f"expected {tok} before {self.at}, found {self.tok or 'the end'!r}")
        self.step()

    def parse(self) -> list[tuple]:
        while self.kind != "end":
            word = self.tok.lower()
            if word in ("@prefix", "prefix") and self.kind in ("at", "word"):
                self.step()
                name = self.step()
                self.prefixes[name[:-1]] = self.iri()
                if word[0] == "@":
                    self.need(".")
            elif word in ("@base", "base") and self.kind in ("at", "word"):
                self.step()
                self.base = self.iri()
                if word[0] == "@":
                    self.need(".")
            elif self.tok == "{":
                self.block(None)
            elif word == "graph" and self.kind == "word":
                self.step()
                self.block(self.node())
            else:
                blank = self.tok == "["
                s = self.node()
                if self.tok == "{":
                    self.block(s)
                else:
                    self.statement(s, blank)
                    self.need(".")
        return self.out

    def block(self, graph: dict | None) -> None:
        self.need("{")
        self.graph = graph
        while self.tok != "}":
            blank = self.tok == "["
            self.statement(self.node(), blank)
            if self.tok != "}":
                self.need(".")
        self.need("}")
        self.graph = None

    def statement(self, s: dict, blank: bool) -> None:
        if blank and self.tok in (".", "}"):
            return
        self.properties(s)

    def properties(self, s: dict) -> None:
        while True:
            if self.tok == "a" and self.kind == "word":
                self.step()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.out.append((s, p, self.node(), self.graph))
                if self.tok != ",":
                    break
                self.step()
            if self.tok != ";":
                return
            while self.tok == ";":
                self.step()
            if self.tok in (".", "]", "}"):
                return

    def blank(self, label: str | None = None) -> dict:
        if label is None:
            self.fresh += 1
            label = f"!{self.fresh}"
        return _term(0, "b" + hashlib.md5(f"{self.scope} {label}".encode()).hexdigest()[:20])

    def iri(self) -> str:
        kind, tok = self.kind, self.tok
        self.step()
        if kind == "iri":
            return urljoin(self.base, unescape_string(tok[1:-1])) if self.base else unescape_string(tok[1:-1])
        if kind == "pname":
            prefix, _, local = tok.partition(":")
            if prefix in self.prefixes:
                return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
            raise RdfSyntaxError(f"unknown prefix {prefix!r}")
        raise RdfSyntaxError(f"expected an IRI, found {tok!r}")

    def node(self) -> dict:
        kind, tok = self.kind, self.tok
        if kind in ("iri", "pname"):
            return _term(1, self.iri())
        if kind == "bnode":
            self.step()
            return self.blank(tok)
        if kind == "string":
            self.step()
            cut = 3 if tok[:3] in ('"""', "'''") and len(tok) >= 6 else 1
            v = unescape_string(tok[cut:-cut])
            if self.kind == "at":
                return _term(2, v, "rdf:langString", self.step()[1:].lower())
            if self.tok == "^^":
                self.step()
                return _term(2, v, compact_type(self.iri()))
            return _term(2, v, "xsd:string")
        if kind == "number":
            self.step()
            return _term(2, tok, "xsd:double" if "e" in tok.lower() else "xsd:decimal" if "." in tok else "xsd:integer")
        if kind == "word" and tok in ("true", "false"):
            self.step()
            return _term(2, tok, "xsd:boolean")
        if tok == "[":
            self.step()
            b = self.blank()
            if self.tok != "]":
                self.properties(b)
            self.need("]")
            return b
        if tok == "(":
            self.step()
            items = []
            while self.tok != ")":
                items.append(self.node())
            self.step()
            head = _term(1, RDF + "nil")
            for item in reversed(items):
                b = self.blank()
                self.out.append((b, RDF + "first", item, self.graph))
                self.out.append((b, RDF + "rest", head, self.graph))
                head = b
            return head
        raise RdfSyntaxError(f"unexpected {tok or 'end'!r} before {self.at}")


_XML_NS = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


def _xml(data: bytes, scope: str) -> list[tuple]:
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        raise RdfSyntaxError(str(e)) from None
    out: list[tuple] = []
    fresh = [0]

    def blank(label: str | None = None) -> dict:
        if label is None:
            fresh[0] += 1
            label = f"!{fresh[0]}"
        return _term(0, "b" + hashlib.md5(f"{scope} {label}".encode()).hexdigest()[:20])

    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def context(e, base: str, lang: str | None) -> tuple[str, str | None]:
        return e.get(_XML_NS + "base", base), e.get(_XML_NS + "lang", lang)

    def plain(text: str, lang: str | None) -> dict:
        return _term(2, text, "rdf:langString", lang.lower()) if lang else _term(2, text, "xsd:string")

    def node(e, base: str, lang: str | None) -> dict:
        base, lang = context(e, base, lang)
        if e.get(_R + "about") is not None:
            s = _term(1, urljoin(base, e.get(_R + "about")))
        elif e.get(_R + "ID") is not None:
            s = _term(1, urljoin(base, "#" + e.get(_R + "ID")))
        else:
            s = blank(e.get(_R + "nodeID"))
        if e.tag != _R + "Description":
            out.append((s, RDF + "type", _term(1, name(e.tag)), None))
        for k, v in e.attrib.items():
            if k == _R + "type":
                out.append((s, RDF + "type", _term(1, urljoin(base, v)), None))
            elif not k.startswith((_R, _XML_NS)):
                out.append((s, name(k), plain(v, lang), None))
        count = 0
        for c in e:
            if c.tag == _R + "li":
                count += 1
                prop(s, f"{RDF}_{count}", c, base, lang)
            else:
                prop(s, name(c.tag), c, base, lang)
        return s

    def prop(s: dict, p: str, e, base: str, lang: str | None) -> None:
        base, lang = context(e, base, lang)
        kind, res, nid, dt = e.get(_R + "parseType"), e.get(_R + "resource"), e.get(_R + "nodeID"), e.get(_R + "datatype")
        extra = [(k, v) for k, v in e.attrib.items() if not k.startswith((_R, _XML_NS)) or k == _R + "type"]
        if kind == "Resource":
            o = blank()
            out.append((s, p, o, None))
            for c in e:
                prop(o, name(c.tag), c, base, lang)
            return
        if kind == "Collection":
            head = _term(1, RDF + "nil")
            for item in reversed([node(c, base, lang) for c in e]):
                b = blank()
                out.append((b, RDF + "first", item, None))
                out.append((b, RDF + "rest", head, None))
                head = b
            o = head
        elif kind == "Literal":
            o = _term(2, (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), RDF + "XMLLiteral")
        elif res is not None or nid is not None or extra:
            o = _term(1, urljoin(base, res)) if res is not None else blank(nid)
            for k, v in extra:
                out.append((o, RDF + "type", _term(1, urljoin(base, v)), None) if k == _R + "type" else (o, name(k), plain(v, lang), None))
        elif len(e):
            o = node(e[0], base, lang)
        elif dt is not None:
            o = _term(2, e.text or "", compact_type(urljoin(base, dt)))
        else:
            o = plain(e.text or "", lang)
        out.append((s, p, o, None))
        if e.get(_R + "ID") is not None:
            r = _term(1, urljoin(base, "#" + e.get(_R + "ID")))
            for q, x in (("type", _term(1, RDF + "Statement")), ("subject", s), ("predicate", _term(1, p)), ("object", o)):
                out.append((r, RDF + q, x, None))

    base, lang = context(root, "", None)
    for e in root if root.tag == _R + "RDF" else [root]:
        node(e, base, lang)
    return out


def parse_document(data: bytes, path: str, fail: bool = True) -> list[tuple]:
    """(s, p, o, g) statements of a whole file, terms as dicts; raises RdfSyntaxError, of line formats only if ``fail``."""
    kind, data = format_of(path), unpack(data, path)
    if kind == "turtle":
        return _Turtle(data.decode("utf-8-sig"), path).parse()
    if kind == "xml":
        return _xml(data, path)
    if kind == "lines":
        lines = data.removeprefix(b"\xef\xbb\xbf").split(b"\n")
        name = re.sub(r"\.bz2$", ".gz", path)
        got = parse_lines([name] * len(lines), [x.rstrip(b"\r") for x in lines], False)
        bad = next((i for i, r in enumerate(got) if r[0] == "rejected"), None)
        if bad is not None and fail:
            raise RdfSyntaxError(f"{path}, line {bad + 1}: {got[bad][1]}")
        return [_scoped(r[2], path) for r in got if r[2]]
    raise RdfSyntaxError(f"{path}: unknown format")


def _scoped(st: tuple, path: str) -> tuple:
    def fix(t: dict | None) -> dict | None:
        return t if t is None or t["k"] else t | {"v": "b" + hashlib.md5(f"{path} {t['v']}".encode()).hexdigest()[:20]}

    return fix(st[0]), st[1], fix(st[2]), fix(st[3])


def _labels(terms: pa.StructArray, paths: pa.Array) -> pa.StructArray:
    """Terms whose blank nodes are named by file and label."""
    kind, v, dt, lang = terms.flatten()
    blank = pc.fill_null(pc.equal(kind, 0), False)
    if not pc.any(blank).as_py():
        return terms
    new = ["b" + hashlib.md5(f"{p} {x}".encode()).hexdigest()[:20] for p, x in zip(paths.filter(blank).to_pylist(), v.filter(blank).to_pylist())]
    return pa.StructArray.from_arrays([kind, pc.replace_with_mask(v, blank, pa.array(new, pa.string())), dt, lang], names=["k", "v", "dt", "lang"], mask=terms.is_null())


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(QUADS)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(target)], schema=target)


def read_rdf(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """Statements (s, p, o, g) of the files that a path or glob names.

    FAILFAST raises for files of unknown format and for syntax errors, bytes that aren't UTF-8 among them; PERMISSIVE
    leaves out such files and, in line formats, only the lines concerned.
    """
    fail = mode.upper() == "FAILFAST"
    files = spark.read.format("binaryFile").load(path)
    line = F.col("path").rlike(r"(?i)\.(nt|nq)(\.gz|\.bz2)?$")
    known = F.col("path").rlike(r"(?i)\.(" + "|".join(FORMATS) + r")(\.gz|\.bz2)?$")
    if fail:
        odd = files.where(~known).select("path").limit(1).collect()
        if odd:
            raise RdfSyntaxError(f"{odd[0].path}: unknown format")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = parse_document(data, unquote(p))
                except (RdfSyntaxError, UnicodeDecodeError, OSError):
                    if fail:
                        raise
                    continue
                for i in range(0, len(rows), 10_000):
                    yield _arrow(rows[i : i + 10_000])

    def by_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            paths = [re.sub(r"(?i)\.bz2$", ".gz", unquote(p)) for p in b.column(1).to_pylist()]
            texts = b.column(0).cast(pa.binary()).to_pylist()
            code, cols = parse_columns([p.lower() for p in paths], texts, False)
            bad = np.flatnonzero(code > VALID)
            if fail and len(bad):
                raise RdfSyntaxError(f"{paths[bad[0]]}: {KINDS[code[bad[0]]]} in {texts[bad[0]][:80]!r}")
            there = pa.array(code == VALID)
            names = pa.array(paths).filter(there)
            s, p, o, g = (c.filter(there) for c in cols)
            target = to_arrow_schema(QUADS)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip((_labels(s, names), p, _labels(o, names), _labels(g, names)), target)], schema=target)

    documents = files.where(known & ~line).select("path", "content").mapInArrow(whole, QUADS)
    names = [r.path for r in files.where(line).select("path").collect()]  # a file listing, as the driver has it anyway
    if not names:
        return documents
    lines = spark.read.text(names).select("value", F.col("_metadata.file_path").alias("path")).mapInArrow(by_line, QUADS)
    return documents.union(lines)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, fail: bool):
        self.path, self.fail = path, fail

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.path.removeprefix("file://")
        names = sorted(glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path))
        if self.fail:
            odd = next((n for n in names if format_of(n) is None), None)
            if odd:
                raise RdfSyntaxError(f"{odd}: unknown format")
        return [_File(n) for n in names if format_of(n)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        try:
            rows = parse_document(data, partition.path, self.fail)
        except (RdfSyntaxError, UnicodeDecodeError):
            if self.fail:
                raise
            return
        tup = lambda t: None if t is None else (t["k"], t["v"], t["dt"], t["lang"])
        for s, p, o, g in rows:
            yield tup(s), p, tup(o), tup(g)


class RdfDataSource(DataSource):
    """``spark.read.format("rdf").load(path)`` after ``spark.dataSource.register(RdfDataSource)``; for files on a file system mounted on every node."""

    @classmethod
    def name(cls) -> str:
        return "rdf"

    def schema(self) -> T.StructType:
        return QUADS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("mode", "FAILFAST").upper() == "FAILFAST")


def nquads(quads: DataFrame) -> DataFrame:
    """One N-Quads line (column value) for each statement."""
    def iri(c):
        return F.concat(F.lit("<"), c, F.lit(">"))

    def term(t):
        v = t["v"]
        esc = v
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            esc = F.replace(esc, F.lit(a), F.lit(b))
        full = F.when(t["dt"].startswith("xsd:"), F.concat(F.lit("http://www.w3.org/2001/XMLSchema#"), F.substring(t["dt"], 5, 1000))).otherwise(t["dt"])
        lit = F.concat(F.lit('"'), esc, F.lit('"'), F.when(t["dt"] == "rdf:langString", F.concat(F.lit("@"), t["lang"])).when(t["dt"] == "xsd:string", "").otherwise(F.concat(F.lit("^^"), iri(full))))
        return F.when(t["k"] == 0, F.concat(F.lit("_:"), v)).when(t["k"] == 1, iri(v)).otherwise(lit)

    g = F.when(F.col("g").isNull(), "").otherwise(F.concat(F.lit(" "), term(F.col("g"))))
    return quads.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select(F.concat(term(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), term(F.col("o")), g, F.lit(" .")).alias("value"))


def write_lines(lines: DataFrame, path: str, extension: str, **options: object) -> None:
    """Writes the text column of a table to files of a format: the text writer's part files, renamed. Every line, or file, has to be a document of it."""
    spark = lines.sparkSession
    lines.write.options(compression="gzip", **options).text(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "part-*.txt.gz")):
        name = st.getPath().getName()
        fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.replace(".txt.gz", f".{extension}.gz")))


def write_nquads(quads: DataFrame, path: str) -> None:
    """Writes files *.nq.gz that read_rdf reads."""
    write_lines(nquads(quads), path, "nq")
