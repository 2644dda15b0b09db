"""Statement lines to loaded statements and reasoned rejects by structural indexing.

A batch of lines is one byte buffer. numpy masks mark quotes, angle brackets, white space and other structural
bytes; the parity of the backslash run before a quote tells whether it is protected; reversed running minima turn
each mask into "next position at or after i". A vectorised cursor then hops from token to token on all lines of
the batch at once, one step a token, so delimiters and record ends are located without a scan by character. Counts
of tokens and type checks of their texts decide between a valid row and a reject with the first reason that applies.
The checks are vectorised too: prefix sums of masks tell whether a span holds a byte it must not hold, and texts are
looked at in Python once for each different datatype, tag and typed text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.xsd import XSD, valid

TERM = T.StructType([T.StructField("k", T.ByteType()), T.StructField("v", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])
OUT = [
    T.StructField("line_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
    *(T.StructField(x, TERM if x != "p" else T.StringType()) for x in ("s", "p", "o", "g")),
]
SCHEMA = T.StructType(OUT)
#: Bytes of lines that are indexed at once; a longer line is a slice of its own.
SLICE_BYTES = 1 << 20
IRI, BNODE, LITERAL, STOP = 1, 2, 3, 4
#: Tokens of a line that are told apart: a statement has five at most. A longer line can't be one; the rest of it is only tried for being readable.
MAX_TOKENS = 6
#: What a line is: its place in this list.
KINDS = ("skipped", "valid", "unknown_format", "quoting", "columns", "value")
SKIPPED, VALID, FORMAT, QUOTING, COLUMNS, VALUE = range(6)

_READABLE = re.compile(rb"""(?:[ \t.]++|<[^>]*+>|_:[A-Za-z0-9]++|"(?:[^"\\]++|\\.)*+"(?:@[^ \t.<"#]*+|\^\^<[^>]*+>)?+)*+(?:#.*)?""", re.S)
_LINES = re.compile(r"\.(?:nt|nq)(?:\.gz)?\Z")
_QUADS = re.compile(r"\.nq(?:\.gz)?\Z")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: The ``k`` of a term by the kind of its token.
_TERM_KIND = np.array([0, 1, 0, 2, 0], np.int8)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_BAD_IRI = re.compile("[\x00-\x20\x7f-\x9f<>\"{}|^`\\\\]")
_TAG = re.compile(r"[A-Za-z]+(?:-[A-Za-z0-9]+)*")
_ESCAPE = re.compile(r"\\(?:([tbnrf\"'\\])|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|)")
_ECHAR = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str | None:
    """The text of a literal, or None if it holds a sequence that N-Quads doesn't know."""
    if "\\" not in text:
        return text
    bad = False

    def sub(m: re.Match) -> str:
        nonlocal bad
        if m[1]:
            return _ECHAR[m[1]]
        code = int(m[2] or m[3] or "110000", 16)
        if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            bad = True
            return ""
        return chr(code)

    out = _ESCAPE.sub(sub, text)
    return None if bad else out


def _iri_ok(iri: str) -> bool:
    return bool(_SCHEME.match(iri)) and not _BAD_IRI.search(iri)


def _next(mask: np.ndarray) -> np.ndarray:
    """Position of the first True at or after each index; len(mask) where there is none."""
    n = len(mask)
    at = np.where(mask, np.arange(n, dtype=np.int32), np.int32(n))
    return np.append(np.minimum.accumulate(at[::-1])[::-1], np.int32(n))


def _protected(buf: np.ndarray) -> np.ndarray:
    """True where an odd number of backslashes stands before a byte."""
    n = len(buf)
    idx = np.arange(n, dtype=np.int32)
    # distance to the last byte that isn't a backslash
    last_other = np.maximum.accumulate(np.where(buf == 92, np.int32(-1), idx)) if n else idx
    before = np.concatenate([[-1], last_other[:-1]]) if n else idx
    return ((idx - 1 - before) & 1).astype(bool)


def tokens(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token kinds and spans of lines, all lines at once.

    Returns kind, a, b, c, d of shape (lines, tokens) and a mask of lines that can't be read: a..b is the text of
    the term, c..d that of a literal's tag or datatype; c is -1 without one and d is negated for a tag.
    """
    n = len(buf)
    odd = _protected(buf)
    blank = (buf == 32) | (buf == 9)
    digit_letter = ((buf >= 48) & (buf <= 57)) | ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122))
    gt, close, solid, word_end = _next(buf == 62), _next((buf == 34) & ~odd), _next(~blank), _next(~digit_letter)
    tag_end = _next(blank | (buf == 46) | (buf == 60) | (buf == 34) | (buf == 35))
    byte = np.append(buf, np.zeros(3, np.uint8))
    lines = len(start)
    bad = np.zeros(lines, bool)
    cursor, active = start.astype(np.int32).copy(), np.arange(lines)
    out: list[tuple[np.ndarray, ...]] = []
    for _ in range(MAX_TOKENS + 1):
        cur = np.minimum(solid[cursor[active]], end[active])
        ch = byte[cur]
        go = (cur < end[active]) & (ch != 35)
        active, cur, ch = active[go], cur[go], ch[go]
        if not len(active):
            break
        stop = end[active]
        kind = np.zeros(len(active), np.int8)
        a, b = cur + 1, cur + 1
        c, d = np.full(len(active), -1, np.int32), np.full(len(active), -1, np.int32)
        nxt = cur + 1
        fail = np.ones(len(active), bool)
        m = ch == 60
        if m.any():
            e = gt[cur[m] + 1]
            kind[m], b[m], nxt[m], fail[m] = IRI, e, e + 1, e >= stop[m]
        m = ch == 95
        if m.any():
            s = np.minimum(cur[m] + 2, n)
            e = np.minimum(word_end[s], stop[m])
            kind[m], a[m], b[m], nxt[m] = BNODE, s, e, e
            fail[m] = (byte[cur[m] + 1] != 58) | (e <= s) | (cur[m] + 1 >= stop[m])
        m = ch == 46
        kind[m], fail[m] = STOP, False
        m = ch == 34
        if m.any():
            e = close[cur[m] + 1]
            wrong = e >= stop[m]
            e = np.minimum(e, n)
            f = np.minimum(e + 1, n)
            inside = f < stop[m]
            at = inside & (byte[f] == 64)
            typed = inside & (byte[f] == 94)
            h = np.minimum(f + 1, n)
            te = np.minimum(tag_end[h], stop[m])
            ie = gt[np.minimum(f + 3, n)]
            wrong |= typed & ((byte[h] != 94) | (byte[np.minimum(f + 2, n)] != 60) | (ie >= stop[m]) | (f + 2 >= stop[m]))
            kind[m], b[m], fail[m] = LITERAL, e, wrong
            c[m] = np.where(at, h, np.where(typed, f + 3, -1))
            d[m] = np.where(at, -te - 1, np.where(typed, ie, -1))
            nxt[m] = np.where(at, te, np.where(typed, ie + 1, f))
        bad[active[fail]] = True
        ok = ~fail
        active = active[ok]
        row = [np.zeros(lines, np.int8), *(np.zeros(lines, np.int32) for _ in range(4))]
        for r, v in zip(row, (kind, a, b, c, d)):
            r[active] = v[ok]
        out.append(tuple(row))
        cursor[active] = nxt[ok]
    else:
        for i in active.tolist():
            bad[i] |= not _READABLE.fullmatch(buf[cursor[i] : end[i]].tobytes())
    if not out:
        z = np.zeros((lines, 0), np.int32)
        return z.astype(np.int8), z, z, z, z, bad
    return (*(np.stack([o[i] for o in out], axis=1) for i in range(5)), bad)


def _total(mask: np.ndarray) -> np.ndarray:
    """How many of the mask's first i are True."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:], dtype=np.int32)
    return out


def _gather(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The spans a..b of a buffer as texts."""
    size = (b - a).astype(np.int64)
    offsets = np.zeros(len(a) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(buf[at])]).cast(pa.string())


def _in(buf: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[buf]


@dataclass
class _Slice:
    """What the lines of a slice are, and the terms of the valid ones: kind, text, datatype and tag of s, p, o, g."""

    codes: np.ndarray
    terms: list[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]


def _slice(texts: list[bytes], known: np.ndarray, quads: np.ndarray, types_checked: bool) -> _Slice:
    data = b"\n".join(texts)
    n_lines = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n_lines)
    start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    end = start + lengths
    buf = np.frombuffer(data, np.uint8)
    byte = np.append(buf, np.zeros(3, np.uint8))
    code = np.full(n_lines, VALID, np.int8)
    # blank lines and comments; white space beyond ASCII is looked at in Python
    first = np.minimum(_next(~_in(buf, b"\t\n\v\f\r\x1c\x1d\x1e\x1f "))[start], end)
    code[(first >= end) | (byte[np.minimum(first, len(buf))] == 35)] = SKIPPED
    for i in np.flatnonzero((first < end) & (byte[np.minimum(first, len(buf))] >= 128)).tolist():
        if texts[i].decode(errors="replace").lstrip()[:1] in ("", "#"):
            code[i] = SKIPPED
    code[(code == VALID) & ~known] = FORMAT
    try:
        data.decode()
    except UnicodeDecodeError:
        for i in np.flatnonzero(code == VALID).tolist():
            try:
                texts[i].decode()
            except UnicodeDecodeError:
                code[i] = QUOTING
    todo = np.flatnonzero(code == VALID)
    none = [(pa.array([], pa.int8()), *(pa.array([], pa.string()),) * 3)] * 4
    if not len(todo):
        return _Slice(code, none)
    kind, a, b, c, d, bad = tokens(buf, start[todo], end[todo])
    n_tokens, stops = (kind > 0).sum(axis=1), (kind == STOP).sum(axis=1)
    terms = n_tokens - stops
    last = kind[np.arange(len(todo)), np.maximum(n_tokens - 1, 0)] == STOP if kind.shape[1] else np.zeros(len(todo), bool)
    shaped = (stops == 1) & last & ((terms == 3) | (quads[todo] & (terms == 4)))
    code[todo[~shaped]] = COLUMNS
    code[todo[bad]] = QUOTING
    good = shaped & ~bad
    todo, terms = todo[good], terms[good]
    if not len(todo):
        return _Slice(code, none)
    # the stop of a triple stands where a quad has its graph
    there = np.arange(4) < terms[:, None]
    kind, a, b, c, d = (np.where(there, x[good][:, :4], 0) for x in (kind, a, b, c, d))
    wrong_byte = _in(buf, bytes(range(33)) + b'\x7f<>"{}|^`\\')
    wrong_byte[:-1] |= (buf[:-1] == 0xC2) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9F)
    wrong, no_scheme, colon = _total(wrong_byte), _total(~_in(buf, _LETTERS + b"0123456789+.-")), _next(buf == 58)
    letter = _in(byte, _LETTERS)

    def iri_ok(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        e = colon[a]
        return (e < b) & letter[a] & (no_scheme[e] == no_scheme[a]) & (wrong[b] == wrong[a])

    lit = kind[:, 2] == LITERAL
    la, lb, lc, ld = (x[:, 2] for x in (a, b, c, d))
    typed, tagged = lit & (lc >= 0) & (ld >= 0), lit & (lc >= 0) & (ld < 0)
    ok = (kind[:, 1] == IRI) & (kind[:, 0] != LITERAL) & (kind[:, 3] != LITERAL)
    for k in range(4):
        ok &= (kind[:, k] != IRI) | iri_ok(a[:, k], b[:, k])
    ok[typed] &= iri_ok(lc[typed], ld[typed])
    opens = (buf == 92) & ~_protected(buf)
    unknown, escapes = _total(opens & ~_in(byte[1 : len(buf) + 1], b"tbnrf\"'\\uU")), _total(opens)
    ok &= ~lit | (unknown[lb] == unknown[la])
    # texts of the objects of what is left
    value = _gather(buf, np.where(ok, la, 0), np.where(ok, lb, 0))
    escaped = np.flatnonzero(ok & lit & (escapes[lb] != escapes[la]))
    if len(escaped):
        plain = [unescape(x) for x in value.take(pa.array(escaped)).to_pylist()]
        ok[escaped[[x is None for x in plain]]] = False
        mask = np.zeros(len(ok), bool)
        mask[escaped] = True
        value = pc.replace_with_mask(value, mask, pa.array([x or "" for x in plain], pa.string()))
    types, tags = ["xsd:string", "rdf:langString"], [""]
    type_of, tag_of = np.where(tagged, 1, 0), np.zeros(len(ok), np.int64)
    at = np.flatnonzero(ok & tagged)
    if len(at):
        seen = _gather(buf, lc[at], -ld[at] - 1).dictionary_encode()
        names = seen.dictionary.to_pylist()
        which = np.asarray(seen.indices)
        ok[at] &= np.array([bool(_TAG.fullmatch(x)) for x in names])[which]
        tags, tag_of[at] = [x.lower() for x in names], which
    at = np.flatnonzero(ok & typed)
    if len(at):
        seen = _gather(buf, lc[at], ld[at]).dictionary_encode()
        which = np.asarray(seen.indices)
        for j, iri in enumerate(seen.dictionary.to_pylist()):
            local = iri[4:] if iri.startswith("xsd:") else iri[len(XSD) :] if iri.startswith(XSD) else None
            mine = at[which == j]
            type_of[mine] = len(types)
            types.append("xsd:" + local if local else iri)
            if local and types_checked:
                texts_of = value.take(pa.array(mine)).dictionary_encode()
                ok[mine] &= np.array([valid(local, x) for x in texts_of.dictionary.to_pylist()], bool)[np.asarray(texts_of.indices)]
    code[todo[~ok]] = VALUE
    kind, a, b, lit, tagged, type_of, tag_of = (x[ok] for x in (kind, a, b, lit, tagged, type_of, tag_of))
    out = []
    for k in range(4):
        is_literal = lit if k == 2 else np.zeros(len(kind), bool)
        v = value.filter(pa.array(ok)) if k == 2 else _gather(buf, a[:, k], b[:, k])
        dt = pa.DictionaryArray.from_arrays(pa.array(type_of, pa.int32(), mask=~is_literal), pa.array(types, pa.string())).dictionary_decode()
        lang = pa.DictionaryArray.from_arrays(pa.array(tag_of, pa.int32(), mask=~(is_literal & tagged)), pa.array(tags, pa.string())).dictionary_decode()
        out.append((pa.array(_TERM_KIND[kind[:, k]], mask=kind[:, k] == 0), v, dt, lang))
    return _Slice(code, out)


def parse_columns(paths: list[str | None], texts: list[bytes | None], types_checked: bool = True) -> tuple[np.ndarray, list[pa.Array]]:
    """What each line is (its place in KINDS) and the columns s, p, o, g, null where it isn't valid. Without
    ``types_checked`` a literal's text needn't be valid in its datatype."""
    known = {p: (bool(_LINES.search(p or "")), bool(_QUADS.search(p or ""))) for p in set(paths)}
    code = np.zeros(len(texts), np.int8)
    parts: list[_Slice] = []
    todo: list[int] = []
    size = 0

    def cut() -> None:
        kinds = [known[paths[i]] for i in todo]
        got = _slice([texts[i] for i in todo], np.array([x[0] for x in kinds]), np.array([x[1] for x in kinds]), types_checked)
        code[todo] = got.codes
        parts.append(got)

    for i, t in enumerate(texts):
        if t is None:
            continue
        todo.append(i)
        size += len(t)
        if size > SLICE_BYTES:
            cut()
            todo, size = [], 0
    if todo:
        cut()
    place = np.full(len(texts), -1)
    place[code == VALID] = np.arange((code == VALID).sum())
    at = pa.array(place, mask=place < 0)
    out = []
    for k in range(4):
        kinds, v, dt, lang = (pa.concat_arrays([p.terms[k][j] for p in parts] or [t]).take(at) for j, t in enumerate((pa.array([], pa.int8()), *(pa.array([], pa.string()),) * 3)))
        out.append(v if k == 1 else pa.StructArray.from_arrays([kinds, v, dt, lang], names=["k", "v", "dt", "lang"], mask=kinds.is_null()))
    return code, out


def parse_lines(paths: list[str | None], texts: list[bytes | None], types_checked: bool = True) -> list[tuple[str, str | None, tuple | None]]:
    """(status, reason, statement) of lines; status is valid, skipped or rejected. A statement is (s, p, o, g)."""
    code, cols = parse_columns(paths, texts, types_checked)
    rows = zip(code.tolist(), *(c.to_pylist() for c in cols))
    return [(KINDS[k], None, st if k == VALID else None) if k <= VALID else ("rejected", KINDS[k], None) for k, *st in ((k, *x) for k, *x in rows)]


def load_lines(lines: DataFrame) -> DataFrame:
    """line_id, path, line_no, status (valid, rejected, skipped), reason, and the statement (s, p, o, g) of valid lines.

    Null or blank lines and comment lines are skipped, also in files of an unknown format. A null path has an
    unknown format. A line that isn't UTF-8 can't be read: 'quoting'. Lines of any length are read whole; repeated lines are rows of their own; an empty table gives
    an empty table; extra columns are dropped. There is no shuffle: a partition's lines are parsed where they are read.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(SCHEMA)
        for b in batches:
            get = lambda name: b.column(b.schema.get_field_index(name))
            code, terms = parse_columns(get("path").to_pylist(), get("line").cast(pa.binary()).to_pylist())
            status = pa.DictionaryArray.from_arrays(np.minimum(code, 2), pa.array(["skipped", "valid", "rejected"])).dictionary_decode()
            reason = pa.DictionaryArray.from_arrays(pa.array(code, mask=code <= VALID), pa.array(KINDS)).dictionary_decode()
            cols = [get("line_id"), get("path"), get("line_no"), status, reason, *terms]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, target)], schema=target)

    return lines.select("line_id", "path", "line_no", "line").mapInArrow(parse, SCHEMA)
