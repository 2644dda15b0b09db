"""Items of varying length into containers of fixed capacity by pattern packing with non-negative least squares.

Only the histogram of lengths reaches the driver: its size is bounded by the capacity, not by the documents. There
the lengths are put into bins, patterns of few bins that fill a container are enumerated, and their repeat counts are
fitted to the histogram by non-negative least squares and rounded down. Patterns are then made of exact lengths;
what remains is packed into the free space of patterns and into further containers, each length into the smallest
space that takes it. The plan is a list of (lengths, repeat count). Documents are numbered within their length by exact offset
chunking and find their container by that number, so no task or driver sees them all.

An item beyond the capacity is split into full containers and one rest; no other item is split.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chunks import number_rows
from ..workspace import Workspace

BINS = 128
PATTERN_ITEMS = 3
#: Beyond so many slots (huge capacities) they are joined by a shuffle.
BROADCAST_SLOTS = 500_000


def default_tokenizer() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def count_tokens(enc, text: str) -> int:
    """Tokens of a text of any form.

    The pattern steps back once for each character of a run of white space, which overflows the stack on very long
    runs. Such a run is one piece without its last character, which goes with what follows, so the text is cut there.
    """
    n, at = 0, 0
    for m in _SPACES.finditer(text) if len(text) >= 4096 else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of whole texts in tokens of a byte-level BPE given as a file of ranks; null texts have 0. Special tokens are ordinary text."""
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as P
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [count_tokens(enc, t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, T.StructType([documents.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 4 * BINS) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by the active set method of Lawson and Hanson on the normal equations."""
    ata, atb = a.T @ a, a.T @ b
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    w = atb.copy()
    ridge = 1e-10 * max(1.0, float(ata.diagonal().max(initial=0)))
    tol = 1e-7 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds):
        cand = np.where(active, -np.inf, w)
        j = int(cand.argmax()) if n else -1
        if n == 0 or cand[j] <= tol:
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            s = np.linalg.solve(ata[np.ix_(idx, idx)] + ridge * np.eye(len(idx)), atb[idx])
            if s.min() > 0:
                break
            neg = s <= 0
            ratio = x[idx][neg] / np.maximum(x[idx][neg] - s[neg], 1e-300)
            x[idx] += ratio.min() * (s - x[idx])
            drop = idx[(x[idx] <= 1e-12) & neg] if ((x[idx] <= 1e-12) & neg).any() else idx[neg][[int(ratio.argmin())]]
            active[drop] = False
            x[drop] = 0
            if not active.any():
                s = np.empty(0)
                break
        x[:] = 0
        x[active] = s
        w = atb - ata @ x
    return x


def patterns(present: np.ndarray, full: int, most: int = PATTERN_ITEMS) -> list[tuple[int, ...]]:
    """Multisets of at most ``most`` present bin sizes that add up to the full container."""
    have, out = set(present.tolist()), []

    def go(rest: int, top: int, left: int, got: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(got)
            return
        if left == 0:
            return
        for s in range(min(rest, top), 0, -1):
            if s * left < rest:
                break
            if s in have:
                go(rest - s, s, left - 1, (*got, s))

    go(full, full, most, ())
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeat count) of containers that hold every item of the histogram {length: count} exactly once; lengths are 1..capacity."""
    left = {int(n): int(c) for n, c in histogram.items() if c > 0}
    if not left:
        return []
    if min(left) < 1 or max(left) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    bins = min(BINS, capacity)
    of = lambda n: -(-n * bins // capacity)  # noqa: E731  the bin's upper end, so a pattern never overflows
    by_bin: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        by_bin.setdefault(of(n), []).append(n)
    sizes = np.array(sorted(by_bin))
    pats = patterns(sizes, bins)
    groups: list[tuple[tuple[int, ...], int]] = []
    if pats:
        a = np.zeros((bins + 1, len(pats)))
        for j, p in enumerate(pats):
            for s in p:
                a[s, j] += 1
        h = np.zeros(bins + 1)
        for s, ns in by_bin.items():
            h[s] = sum(left[n] for n in ns)
        weight = 0.1 + np.arange(bins + 1) / bins  # short items that remain are easily placed
        x = nnls(a * weight[:, None], h * weight)
        stock = {s: int(h[s]) for s in by_bin}
        for j in np.argsort(-x):
            p = pats[j]
            times = min([int(x[j] + 1e-6), *(stock[s] // p.count(s) for s in set(p))])
            if times <= 0:
                continue
            for s in set(p):
                stock[s] -= times * p.count(s)
            # runs of equal exact lengths of each slot, aligned
            runs = []
            for s in p:
                need, run = times, []
                for n in by_bin[s]:
                    take = min(need, left[n])
                    if take:
                        run.append((n, take))
                        left[n] -= take
                        need -= take
                    if not need:
                        break
                runs.append(run)
            at = [0] * len(runs)
            used = [0] * len(runs)
            done = 0
            while done < times:
                step = min(r[i][1] - u for r, i, u in zip(runs, at, used))
                groups.append((tuple(r[i][0] for r, i in zip(runs, at)), step))
                done += step
                for k in range(len(runs)):
                    used[k] += step
                    if used[k] == runs[k][at[k]][1]:
                        at[k], used[k] = at[k] + 1, 0
    return _residuals(left, groups, capacity)


def _residuals(left: dict[int, int], groups: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts instead of items."""
    space: dict[int, list[list]] = {}
    for lengths, times in groups:
        space.setdefault(capacity - sum(lengths), []).append([lengths, times])
    gaps = sorted(space)

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if gap not in space:
            space[gap] = []
            bisect.insort(gaps, gap)
        space[gap].append([lengths, times])

    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            i = bisect.bisect_left(gaps, n)
            if i == len(gaps):  # no space: containers of this length, as many of it as fit in each
                per = capacity // n
                if todo >= per:
                    put(capacity - per * n, (n,) * per, todo // per)
                    todo %= per
                else:
                    put(capacity - todo * n, (n,) * todo, 1)
                    todo = 0
                continue
            gap = gaps[i]
            group = space[gap][-1]
            per = gap // n
            times = min(group[1], todo // per) if todo >= per else 1
            each = per if todo >= per else todo
            lengths = group[0]
            if times == group[1]:
                space[gap].pop()
                if not space[gap]:
                    del space[gap]
                    gaps.pop(i)
            else:
                group[1] -= times
            put(gap - each * n, lengths + (n,) * each, times)
            todo -= each * times
    merged: dict[tuple[int, ...], int] = {}
    for g in space.values():
        for lengths, times in g:
            key = tuple(sorted(lengths, reverse=True))
            merged[key] = merged.get(key, 0) + times
    return sorted(merged.items(), reverse=True)


def slots(packs: list[tuple[tuple[int, ...], int]], first: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, container of rank_from, slot, offset): items of a length by their number find their place."""
    seen: dict[int, int] = {}
    out, at = [], first
    for lengths, times in packs:
        offset = 0
        for slot, n in enumerate(lengths):
            r = seen.get(n, 0)
            out.append((n, r, r + times, at, slot, offset))
            seen[n] = r + times
            offset += n
        at += times
    return out


def _sizes(capacities: DataFrame) -> DataFrame:
    return capacities.where("capacity_id IS NOT NULL AND max_tokens >= 1").groupBy("capacity_id").agg(F.min("max_tokens").alias("max_tokens"))


def pack(counts: DataFrame, capacities: DataFrame, ws: Workspace) -> DataFrame:
    """Places every document in containers of each capacity.

    counts: (doc_id, n_tokens), one row a document; capacities: (capacity_id, max_tokens). Gives capacity_id,
    container (numbered from 0), slot, pos (first token in the container), doc_id, piece, token_from, n_tokens.
    Documents of no or null tokens need no space and give no row; capacities that are null or below 1 are left out,
    and of several sizes under one capacity_id the smallest counts. Repeated doc_ids are items of their own. Extra columns are ignored.
    """
    spark = counts.sparkSession
    caps = _sizes(capacities)
    sizes = [(r.capacity_id, r.max_tokens) for r in caps.orderBy("capacity_id").collect()]  # a short list of sizes
    docs = counts.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    each = F.array(*[F.struct(F.lit(c).cast(caps.schema["capacity_id"].dataType).alias("capacity_id"), F.lit(size).cast("long").alias("cap")) for c, size in sizes]) if sizes else F.array().cast(T.ArrayType(T.StructType([caps.schema["capacity_id"], T.StructField("cap", T.LongType())])))
    split = docs.select("doc_id", "n_tokens", F.inline(each)).select("capacity_id", "doc_id", "n_tokens", "cap", F.floor(F.col("n_tokens") / F.col("cap")).cast("long").alias("full"), (F.col("n_tokens") % F.col("cap")).alias("rest"))
    # full pieces: containers of their own, numbered by the prefix sums of how many each document fills
    fulls = number_rows(split.where("full > 0").select("capacity_id", "doc_id", "cap", "full"), ["capacity_id"], ["doc_id", "full"], ws, out="at", value="full")
    whole = fulls.select("capacity_id", "doc_id", "cap", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece")).select(
        "capacity_id", (F.col("at") + F.col("piece")).alias("container"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("pos"), "doc_id", "piece", (F.col("piece") * F.col("cap")).alias("token_from"), F.col("cap").alias("n_tokens")
    )
    rests = number_rows(split.where("rest > 0").select("capacity_id", "doc_id", "cap", "full", "rest"), ["capacity_id", "rest"], ["doc_id", "full"], ws, out="rank")
    # the histogram: at most max_tokens rows a capacity
    hist: dict[int, dict[int, int]] = {c: {} for c, _ in sizes}
    for r in rests.groupBy("capacity_id", "rest").agg(F.count(F.lit(1)).alias("n")).collect():
        hist[r.capacity_id][r.rest] = r.n
    filled = {r.capacity_id: r.n for r in fulls.groupBy("capacity_id").agg(F.sum("full").alias("n")).collect()}
    rows = [(c, *s) for c, size in sizes for s in slots(plan(hist[c], size), filled.get(c, 0))]
    names = [T.StructField(n, T.IntegerType() if n == "slot" else T.LongType()) for n in ("rest", "rank_from", "rank_to", "container", "slot", "pos")]
    table = spark.createDataFrame(rows, T.StructType([T.StructField("capacity_id", caps.schema["capacity_id"].dataType), *names]))
    on = (rests.capacity_id == table.capacity_id) & (rests.rest == table.rest) & (rests["rank"] >= table.rank_from) & (rests["rank"] < table.rank_to)
    # slots are bounded by the number of lengths and patterns, hence by the capacities: some ten thousand at any number of documents
    table = F.broadcast(table) if len(rows) <= BROADCAST_SLOTS else table
    placed = rests.join(table, on).select(
        rests.capacity_id, (table.container + rests["rank"] - table.rank_from).alias("container"), table.slot, table.pos, "doc_id", F.col("full").alias("piece"), (F.col("full") * F.col("cap")).alias("token_from"), rests.rest.alias("n_tokens")
    )
    return whole.unionByName(placed)


def summary(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacity_id, n_containers, n_tokens, least (containers that no packing can undercut by space) and fill (share of used space)."""
    got = packed.groupBy("capacity_id").agg((F.max("container") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    joined = got.join(F.broadcast(_sizes(capacities)), "capacity_id")
    return joined.select("capacity_id", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("max_tokens")).cast("long").alias("least"), (F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens"))).alias("fill"))
