"""Distinct counts and joint set sizes from registers on a logarithmic scale with a tunable base.

A sketch of a set has m registers. Every element sends, by its hash, an exponentially distributed value of rate a to
every register; a register keeps K = max over elements of floor(1 - log_b(value)), limited to 0..q+1 (O. Ertl,
"SetSketch: Filling the Gap between MinHash and HyperLogLog", VLDB 2021). Registers merge by maximum, so partial
results of any split of the rows, and of later rows, combine to the sketch of the union.

The first arrivals of a Poisson process of rate a*m whose points fall on random registers are independent
exponentials of rate a for each register; points are drawn in order and an element stops as soon as its next point
can't raise the lowest register. Large sets hence cost O(1) an element.

Standard error of a count: sqrt(((b+1)/(b-1) * ln(b) - 1) / m); b=1.02, m=1024 give 3.1 %. Sets of up to ``sparse``
hashes are kept exactly (64-bit hashes, error below n/2^64) and turn into registers when they grow. Union,
intersection and Jaccard of two sketches are estimated jointly by maximum likelihood from the numbers of
registers that are greater, smaller and equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Config:
    """Registers m, base b, rate a, highest value q+1, and the size up to which a set is kept as hashes."""

    m: int = 1024
    b: float = 1.02
    a: float = 20.0
    q: int = 2**16 - 2
    sparse: int = 256

    @property
    def error(self) -> float:
        """Relative standard error of a count from registers."""
        return math.sqrt(((self.b + 1) / (self.b - 1) * math.log(self.b) - 1) / self.m)


class Sketch:
    """Hashes while small, registers afterwards."""

    __slots__ = ("c", "parts", "size", "reg")

    def __init__(self, c: Config):
        self.c, self.parts, self.size, self.reg = c, [], 0, None

    def add_hashes(self, h: np.ndarray) -> None:
        """h: distinct or repeated 64-bit hashes."""
        if self.reg is not None:
            self._insert(np.unique(h))
            return
        self.parts.append(h)
        self.size += len(h)
        if self.size > 4 * self.c.sparse:
            self._shrink()

    def _shrink(self) -> None:
        h = np.unique(np.concatenate(self.parts)) if len(self.parts) != 1 else np.unique(self.parts[0])
        self.parts, self.size = [h], len(h)
        if len(h) > self.c.sparse:
            self.parts, self.size = [], 0
            self.reg = np.zeros(self.c.m, np.uint16)
            self._insert(h)

    def _insert(self, h: np.ndarray) -> None:
        c, reg = self.c, self.reg
        state = h.astype(np.uint64)
        x = np.zeros(len(h))
        ln_b = math.log(c.b)
        with np.errstate(over="ignore"):
            while len(state):
                state = state + _MIX[0]
                u = ((_splitmix(state) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
                x = x - np.log(u) / (c.a * c.m)
                k = np.floor(1 - np.log(x) / ln_b)
                low = int(reg.min())
                go = k > low
                state, x, k = state[go], x[go], k[go]
                if not len(state):
                    break
                state = state + _MIX[0]
                i = (_splitmix(state) >> np.uint64(32)).astype(np.int64) % c.m
                np.maximum.at(reg, i, np.clip(k, 0, c.q + 1).astype(np.uint16))

    def merge(self, other: Sketch) -> None:
        if other.reg is not None:
            if self.reg is None:
                mine, self.parts, self.size = self.parts, [], 0
                self.reg = other.reg.copy()
                for h in mine:
                    self._insert(np.unique(h))
            else:
                np.maximum(self.reg, other.reg, out=self.reg)
        else:
            for h in other.parts:
                self.add_hashes(h)

    def registers(self) -> np.ndarray:
        """As registers, whatever the form."""
        if self.reg is not None:
            return self.reg
        full = Sketch(self.c)
        full.reg = np.zeros(self.c.m, np.uint16)
        for h in self.parts:
            full._insert(np.unique(h))
        return full.reg

    def count(self) -> tuple[float, float]:
        """(estimate, relative standard error); exact sets have error 0."""
        if self.reg is None:
            self._shrink() if self.parts else None
            if self.reg is None:
                return float(self.size), 0.0
        c = self.c
        s = float(np.sum(np.power(c.b, -self.reg.astype(np.float64))))
        return c.m * (1 - 1 / c.b) / (c.a * math.log(c.b) * s), c.error

    def dump(self) -> bytes:
        if self.reg is None and self.parts:
            self._shrink()
        if self.reg is not None:
            return b"D" + self.reg.astype("<u2").tobytes()
        return b"S" + (self.parts[0].astype("<i8").tobytes() if self.parts else b"")

    @classmethod
    def load(cls, c: Config, raw: bytes) -> Sketch:
        out = cls(c)
        if raw[:1] == b"D":
            out.reg = np.frombuffer(raw, "<u2", offset=1).copy()
        elif len(raw) > 1:
            h = np.frombuffer(raw, "<i8", offset=1)
            out.parts, out.size = [h], len(h)
        return out


def joint(u: Sketch, v: Sketch) -> dict[str, float]:
    """Union, intersection and Jaccard of two sets by maximum likelihood, with the standard error of each.

    Two exact sets give exact numbers. Else both counts are held at their estimates and the likelihood of the
    numbers of greater, smaller and equal registers is maximised over the Jaccard index; its error is that of the
    Fisher information at the maximum. Those of union and intersection follow from it and from the errors of both counts, taken as independent.
    """
    if u.reg is None and v.reg is None:
        a, b = (np.unique(np.concatenate(s.parts)) if s.parts else np.empty(0, np.int64) for s in (u, v))
        inter = len(np.intersect1d(a, b, assume_unique=True))
        union = len(a) + len(b) - inter
        return {"union": float(union), "intersection": float(inter), "jaccard": inter / union if union else 0.0, "jaccard_error": 0.0, "union_error": 0.0, "intersection_error": 0.0}
    c = u.c
    (nu, eu), (nv, ev) = u.count(), v.count()
    counts = math.hypot(nu * eu, nv * ev)  # standard error of nu + nv
    if nu == 0 or nv == 0:
        return {"union": nu + nv, "intersection": 0.0, "jaccard": 0.0, "jaccard_error": 0.0, "union_error": counts, "intersection_error": 0.0}
    ku, kv = u.registers(), v.registers()
    more, less = int((ku > kv).sum()), int((ku < kv).sum())
    same = c.m - more - less
    su, sv = nu / (nu + nv), nv / (nu + nv)
    p = lambda x: -math.log1p(-x * (c.b - 1) / c.b) / math.log(c.b)

    def probabilities(j: float) -> tuple[float, float, float]:
        a, b = p(max(su - sv * j, 0.0)), p(max(sv - su * j, 0.0))
        return a, b, max(1 - a - b, 1e-300)

    def loss(j: float) -> float:
        return -sum(n * math.log(max(x, 1e-300)) for n, x in zip((more, less, same), probabilities(j)))

    lo, hi = 0.0, min(su / sv, sv / su)
    g = (math.sqrt(5) - 1) / 2
    x1, x2 = hi - g * (hi - lo), lo + g * (hi - lo)
    f1, f2 = loss(x1), loss(x2)
    for _ in range(60):
        if f1 <= f2:
            hi, x2, f2 = x2, x1, f1
            x1 = hi - g * (hi - lo)
            f1 = loss(x1)
        else:
            lo, x1, f1 = x1, x2, f2
            x2 = lo + g * (hi - lo)
            f2 = loss(x2)
    j = (lo + hi) / 2
    top = min(su / sv, sv / su)
    step = 1e-4
    at = min(max(j, step), max(top - step, step))
    info = 0.0
    for x, y, z in zip(probabilities(at - step), probabilities(at + step), probabilities(at)):
        info += c.m * ((y - x) / (2 * step)) ** 2 / max(z, 1e-12)
    union = (nu + nv) / (1 + j)
    error = 1 / math.sqrt(info) if info > 0 else 0.0
    by_j = (nu + nv) / (1 + j) ** 2 * error  # the slope of both in the Jaccard index is the same but for its sign
    return {
        "union": union, "intersection": union * j, "jaccard": j, "jaccard_error": error,
        "union_error": math.hypot(counts / (1 + j), by_j), "intersection_error": math.hypot(counts * j / (1 + j), by_j),
    }


# ---- distributed ----


def hashed(*columns: Column) -> Column:
    """The 64-bit identifier that sketches take: xxhash64 of the columns. Nulls are to be filtered out before."""
    return F.xxhash64(*columns)


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*(T.StructField("gset", T.IntegerType()),), *(T.StructField(k, df.schema[k].dataType) for k in keys), T.StructField("sketch", T.BinaryType())])


def _batch(schema: T.StructType, rows: Iterable[tuple[tuple, Sketch]]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target, rows = to_arrow_schema(schema), list(rows)
    cols = [[k[i] for k, _ in rows] for i in range(len(target) - 1)] + [[s.dump() for _, s in rows]]
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(cols, target)], schema=target)


def _batches(schema: T.StructType, held: dict[tuple, Sketch]) -> Iterator[pa.RecordBatch]:
    rows = list(held.items())
    for i in range(0, len(rows), ROWS):
        yield _batch(schema, rows[i : i + ROWS])


#: Bytes of sketches that a task holds before it sends them on as partials, and what a sketch takes besides its hashes.
HELD_BYTES, OBJECT_BYTES = 64 << 20, 400
#: Merged sketches that are sent on at once.
ROWS = 4096


def partials(df: DataFrame, keys: list[str], hash_col: str, config: Config = Config()) -> DataFrame:
    """Partial sketches (gset, keys..., sketch) of the finest groups; gset is 0. Rows with a null hash are left out; null keys are a group.

    Each input partition sketches its own rows before anything is shuffled, so a hot group arrives as one fixed-size
    sketch a partition. Repeated rows change nothing. An empty table gives an empty table.
    """
    schema = _schema(df, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        weight = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(k)) for k in keys]
            code = np.zeros(b.num_rows, np.int64)
            uniq = []
            for col in cols:
                d = col.dictionary_encode(null_encoding="encode")
                uniq.append(d.dictionary.to_pylist())
                code = code * len(uniq[-1]) + np.asarray(d.indices)
            h = np.asarray(b.column(b.schema.get_field_index(hash_col)))
            order = np.argsort(code, kind="stable")
            code, h = code[order], h[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(code)]):
                rest, key = int(code[s]), []
                for u in reversed(uniq):
                    rest, i = divmod(rest, len(u))
                    key.append(u[i])
                k = (0, *reversed(key))
                sk = held.get(k)
                if sk is None:
                    sk = held[k] = Sketch(config)
                    weight += OBJECT_BYTES
                sk.add_hashes(h[s:e])
            weight += 8 * len(h)
            if weight > HELD_BYTES:
                yield from _batches(schema, held)
                held, weight = {}, 0
        yield from _batches(schema, held)

    slim = df.where(F.col(hash_col).isNotNull()).select(*keys, hash_col)
    return slim.mapInArrow(run, schema)


def merge(parts: DataFrame, config: Config = Config(), salts: int = 0) -> DataFrame:
    """Merges partial sketches of equal groups by maximum. ``salts`` > 1 merges each group in so many parts first, for groups with very many partials.

    A task reads its groups' partials sorted and holds one sketch at a time.
    """
    keys = [c for c in parts.columns if c != "sketch"]
    schema = parts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sk, done = None, None, []
        small: list[bytes] = []  # hashes of the group at hand that aren't in its sketch yet

        def settle() -> None:
            if small:
                sk.add_hashes(np.frombuffer(b"".join(small), "<i8"))
                small.clear()

        for b in batches:
            rows = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
            for raw, *key in zip(b.column(b.schema.get_field_index("sketch")).to_pylist(), *rows):
                key = tuple(key)
                if key != at:
                    if sk is not None:
                        settle()
                        done.append((at, sk))
                    at, sk = key, Sketch(config)
                if raw[:1] == b"S":
                    small.append(raw[1:])
                    if len(small) >= 1024:
                        settle()
                else:
                    sk.merge(Sketch.load(config, raw))
                if len(done) >= ROWS:
                    yield _batch(schema, done)
                    done = []
        if sk is not None:
            settle()
            done.append((at, sk))
        if done:
            yield _batch(schema, done)

    # a fixed number: merging costs more than reading, so small shuffles must not be coalesced to a few tasks
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts > 1:
        salted = parts.repartition(n, *keys, (F.rand(seed=7) * salts).cast("int"))
        parts = salted.sortWithinPartitions(*keys).mapInArrow(run, schema)
    return parts.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def roll_up(finest: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """All grouping sets of merged finest sketches: bit i of gset says that key i is rolled up (its column is null there). Merges by maximum; rows needn't be read again."""
    schema, n = finest.schema, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        for b in batches:
            rows = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
            fine = []
            for raw, *key in zip(b.column(b.schema.get_field_index("sketch")).to_pylist(), *rows):
                sk = Sketch.load(config, raw)
                fine.append(((0, *key), sk))
                for mask in range(1, 1 << n):
                    k = (mask, *(None if mask >> i & 1 else x for i, x in enumerate(key)))
                    up = held.get(k)
                    if up is None:
                        up = held[k] = Sketch(config)
                    up.merge(sk)
            if fine:
                yield _batch(schema, fine)
            if len(held) * (2 * config.m + OBJECT_BYTES) > HELD_BYTES:
                yield from _batches(schema, held)
                held = {}
        yield from _batches(schema, held)

    return merge(finest.mapInArrow(run, schema), config)


def estimates(merged: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds estimate, rel_error (standard error; 0: exact) and the 95 % bounds low and high; drops the sketch."""
    keys = [f for f in merged.schema.fields if f.name != "sketch"]
    schema = T.StructType([*keys, *(T.StructField(n, T.DoubleType()) for n in ("estimate", "rel_error", "low", "high"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Sketch.load(config, raw).count() for raw in b.column(b.schema.get_field_index("sketch")).to_pylist()]
            n = np.array([x for x, _ in got])
            e = np.array([x for _, x in got])
            cols = [b.column(b.schema.get_field_index(k.name)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, (n, e, n * (1 - 1.96 * e), n * (1 + 1.96 * e)))], names=schema.names)

    return merged.mapInArrow(run, schema)


def joints(pairs: DataFrame, left: str, right: str, config: Config = Config()) -> DataFrame:
    """Adds n_union, n_intersection, jaccard and the standard error of each to rows that hold two sketches; a null sketch is an empty set. Drops the sketches."""
    keys = [f for f in pairs.schema.fields if f.name not in (left, right)]
    names = ("n_union", "n_intersection", "jaccard", "jaccard_error", "union_error", "intersection_error")
    schema = T.StructType([*keys, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(b.schema.get_field_index(x)).to_pylist() for x in (left, right))
            got = [joint(Sketch.load(config, x or b"S"), Sketch.load(config, y or b"S")) for x, y in zip(a, c)]
            cols = [b.column(b.schema.get_field_index(k.name)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([g[n] for g in got], type=pa.float64()) for n in ("union", "intersection", "jaccard", "jaccard_error", "union_error", "intersection_error"))], names=schema.names)

    return pairs.mapInArrow(run, schema)
