"""Held-out items leaking into documents: size-partitioned MinHash containment search, then exact shingles.

A leak is a run of ``RUN`` consecutive words, hence of RUN - SHINGLE + 1 shingles, so it holds a share of an item's
shingles that depends on the item's size alone. Items are partitioned by the number of their shingles (powers of
two times the least), and each partition has its containment threshold: the shingles of one run over the largest
size of the partition. MinHash can't tell a share that small from a whole item against a long document; the sets that are
hashed are therefore the shingles of every window of RUN words, on both sides. A leaked window is contained with
similarity 1, so one MinHash value a window (a band of one row) has no false negatives, and an item of a partition has as
many bands as windows, fewer where neighbours share their minimum. Neighbouring windows with one minimum make one span.

Items become a table of bands. A bit filter over the bands, of a fixed size whatever the number of items, goes to the
executors; one scan of the documents sends on the spans whose band is in it, and the spans meet on their bands by a
join. There the shingles of both spans are compared exactly, then the runs, and what a document shares with an item is
added up and held against the threshold. With so many items that the filter is full every span takes the join: the
plan and the result stay the same.

Words are maximal runs of letters or digits without case and accents, after escape sequences (JSON, however
nested, and HTML) are resolved and with HTML tags as gaps.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

RUN = 12
SHINGLE = 5
BLOCK = 1 << 16
#: Characters of spans that a task holds before it sends them on.
PASS_CHARS = 4_000_000
#: Bits of the filter over the items' bands, as a power of two: 8 MB.
FILTER = 26
#: Word hashes that a worker keeps.
CACHED = 1 << 20

_ESCAPE = re.compile(r"(?<!\\)\\+(?:u([0-9a-fA-F]{4})|([nrtbf])|([\"/]))|&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;\\]{1,32};?)")
#: No escape sequence that is not a run of backslashes or digits is longer.
_REACH = 40
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: A name and attributes: name=value, or a name alone that HTML knows as a switch or that has a hyphen.
_REAL_TAG = re.compile(
    r"""</?[A-Za-z][^\s<>"'=]*+(?:\s++(?:[^\s"'=/<>]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++)|(?:allowfullscreen|async|autofocus|autoplay|border|checked|compact|controls|default|defer|disabled|download|hidden|inert|ismap|itemscope|loop|multiple|muted|nomodule|noresize|noshade|novalidate|nowrap|open|playsinline|readonly|required|reversed|scoped|selected|[a-z]++-[\w-]++)(?![^\s/>])))*+\s*+/?>""",
    re.I,
)
_HUGE_REFERENCE = re.compile(r"&#0*[1-9][0-9]{7,};?")  # no character has it, and it may be too long for a number
_SURROGATE = re.compile("[\ud800-\udfff]")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def _plain(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16))
    if m[2]:
        return " "
    if m[3]:
        return m[3]
    return " " if _HUGE_REFERENCE.fullmatch(m[0]) else html.unescape(m[0])


def unescaped(text: str) -> str:
    """The text with escape sequences resolved until none is left.

    A sequence that is resolved shortens the text, so this ends. After the first round only the neighbourhood of a
    change can hold a new sequence, so a round costs what it changes, however deep the nesting.
    """
    look = [(0, len(text))]
    while look:
        out, at, size, changes = [], 0, 0, []
        for low, high in look:
            low = max(low, at)
            for m in _ESCAPE.finditer(text, low, high):
                if m.end() == high < len(text):
                    m = _ESCAPE.match(text, m.start())  # it may go on beyond the edge
                new = _plain(m)
                if new == m[0]:
                    continue
                out += (text[at : m.start()], new)
                size += m.start() - at
                changes.append((size, size + len(new)))
                size += len(new)
                at = m.end()
        if not changes:
            break
        out.append(text[at:])
        text = "".join(out)
        look = []
        for low, high in changes:
            low = max(low - _REACH, 0)
            while low and text[low - 1] in "\\0123456789abcdefABCDEF" and not (look and low <= look[-1][1]):
                low -= 1
            high = min(high + _REACH, len(text))
            if look and low <= look[-1][1]:
                look[-1] = (look[-1][0], max(high, look[-1][1]))
            else:
                look.append((low, high))
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _SURROGATE.search(text) else text


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out.append(text[at:start])
        at = end + 3
    return " ".join([*out, text[at:]])


def resolved(text: str) -> str:
    """The text with escape sequences resolved, however nested, and HTML tags replaced by spaces."""
    if "\\" in text or "&" in text:
        text = unescaped(text)
    # what only stands between two signs of code keeps its words
    return _TAG.sub(lambda m: " " if _REAL_TAG.fullmatch(m[0]) else m[0], _without_comments(text)) if "<" in text else text


def words(text: str | None) -> list[str]:
    """Normal words of a text; none for null."""
    if not text:
        return []
    text = resolved(text).casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        text = _MARK.sub("", text)
    return _WORD.findall(text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


_HASHES = _Hashes()


def window_minima(ids: np.ndarray, run: int = RUN, k: int = SHINGLE) -> np.ndarray:
    """MinHash of each window of ``run`` words: the least hash among its shingles of k words."""
    if len(ids) < run:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        low = np.zeros(len(ids) - k + 1, np.uint64)
        for i in range(k):
            low = _mix(low * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i].astype(np.uint64))
    width, have = run - k + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def spans(ws: list[str], run: int = RUN, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int, int]]:
    """(band, first, end): words first..end hold windows whose MinHash is the band; every window is in one span, if ``keep`` is true of its band.

    Long texts are hashed in blocks that overlap by a window less one word. A span has at most as many windows as a
    window has shingles.
    """
    most = run - SHINGLE + 1
    for start in range(0, max(len(ws) - run + 1, 0), BLOCK):
        part = ws[start : start + BLOCK + run - 1]
        low = window_minima(np.fromiter(map(_HASHES.__getitem__, part), np.uint64, len(part)), run)
        at = np.arange(len(low)) if keep is None else np.flatnonzero(keep(low))
        if not len(at):
            continue
        first = last = -2
        band = 0
        for i, b in zip(at.tolist(), low[at].astype(np.int64).tolist()):
            if i == last + 1 and b == band and i - first < most:
                last = i
                continue
            if first >= 0:
                yield band, start + first, start + last + run
            first = last = i
            band = b
        yield band, start + first, start + last + run


class Index:
    """A few items for the search of single texts, by the same spans and the same exact test as the tables."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.run = run
        self.windows: dict[str, set[int]] = {}
        bands = set()
        for item, ws in items:
            for band, first, end in spans(ws, run):
                bands.add(band)
                for w in self._of(ws, first, end):
                    self.windows.setdefault(w, set()).add(item)
        self.bands = np.array(sorted(bands), np.int64)

    def _of(self, ws: list[str], first: int, end: int) -> list[str]:
        return [" ".join(ws[i : i + self.run]) for i in range(first, end - self.run + 1)]

    def search(self, ws: list[str]) -> set[int]:
        """Items that share a run with the words."""
        found: set[int] = set()
        for _, first, end in spans(ws, self.run, lambda low: np.isin(low.astype(np.int64), self.bands)):
            found.update(*(self.windows.get(w, ()) for w in self._of(ws, first, end)))
        return found


def item_bands(items: DataFrame, run: int = RUN) -> DataFrame:
    """(item_id, part, n_shingles, band, first, span): the spans of every item; part is the size partition."""
    least = run - SHINGLE + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["item_id", "part", "n_shingles", "band", "first", "span"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        rows, held = [], 0
        send = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                n = len(ws) - SHINGLE + 1
                part = max(n // least, 1).bit_length() - 1
                for band, first, end in spans(ws, run):
                    rows.append((item, part, n, band, first, " ".join(ws[first:end])))
                    held += len(rows[-1][5])
                    if held > PASS_CHARS:
                        yield send(rows)
                        rows, held = [], 0
        yield send(rows)

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "item_id long, part int, n_shingles long, band long, first long, span string")


def band_filter(bands: DataFrame) -> np.ndarray:
    """2^FILTER bits: bit b is set if a band ends in the bits b. The driver gets its set words, never more than the filter has."""
    low = F.col("band").bitwiseAND(F.lit((1 << FILTER) - 1))
    got = bands.select(low.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint64)
    return out


def _grams(text: Column, n: int) -> Column:
    """The runs of n words of a span, in order."""
    ws = F.split(text, " ")
    return F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))


def containments(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(item_id, doc_id, part, n_shingles, n_shared, containment) of all pairs that share ``run`` consecutive words.

    n_shared counts the item's shingles that lie in shared runs, containment is their share of n_shingles. Documents are
    read once, whatever the number of items. Null or empty texts and items with fewer words than ``run`` match
    nothing; null ids are kept as they are; repeated rows give one pair; extra columns are ignored; empty tables give an
    empty table.
    """
    spark = documents.sparkSession
    least = run - SHINGLE + 1
    bands = Workspace(spark, "leaks").table(item_bands(items, run), "bands", partition_by=["part"])
    shared = spark.sparkContext.broadcast(band_filter(bands))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def keep(low: np.ndarray) -> np.ndarray:
            b = low & np.uint64((1 << FILTER) - 1)
            return (bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)

        rows, held = [], 0
        send = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "band", "doc_span"])
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                seen = {(band, " ".join(ws[first:end])) for band, first, end in spans(ws, run, keep)}
                for band, span in seen:
                    rows.append((doc, band, span))
                    held += len(span)
                    if held > PASS_CHARS:
                        yield send(rows)
                        rows, held = [], 0
        yield send(rows)

    found = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, "doc_id long, band long, doc_span string")
    # exact shingles of the two spans, then the runs that they make; the runs of a span are made once
    inside = F.array_intersect(_grams(F.col("span"), SHINGLE), _grams(F.col("doc_span"), SHINGLE))
    runs = F.array(F.struct(_grams(F.col("span"), run).alias("item"), _grams(F.col("doc_span"), run).alias("doc"), F.col("first").alias("first")))
    hits = F.transform(runs, lambda r: F.filter(F.transform(r["item"], lambda w, i: F.when(F.array_contains(r["doc"], w), r["first"] + i)), lambda i: i.isNotNull()))
    met = found.join(bands, "band").select("item_id", "doc_id", "part", "n_shingles", F.when(F.size(inside) > 0, F.flatten(hits)).alias("hits"))
    at = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(i, i + least - 1))))
    keys = ["item_id", "doc_id", "part", "n_shingles"]
    each = met.select(*keys, F.explode(at).alias("at")).distinct()
    total = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_shared")).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return total.where(F.col("containment") >= F.lit(1.0) / (F.pow(F.lit(2.0), F.col("part") + 1)))


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Distinct (item_id, doc_id) pairs that share ``run`` consecutive words; see ``containments`` for special cases."""
    return containments(documents, items, run).select("item_id", "doc_id").distinct()


def brute_force(documents: pd.DataFrame, items: pd.DataFrame, run: int = RUN) -> set[tuple[int, int]]:
    """The pairs of small frames, by comparing joined words."""
    out = set()
    docs = [(d, " " + " ".join(words(t)) + " ") for d, t in zip(documents.doc_id, documents.text)]
    for item, text in zip(items.item_id, items.text):
        ws = words(text)
        grams = {" " + " ".join(ws[i : i + run]) + " " for i in range(len(ws) - run + 1)}
        out |= {(item, d) for d, t in docs if any(g in t for g in grams)}
    return out
