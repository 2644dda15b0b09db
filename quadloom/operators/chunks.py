"""Exact offset chunking: per-key work without tasks that grow with the hottest key.

Rows are range-partitioned by (key, order), so a key that owns a third of the table is spread over a third of
the partitions. Each partition counts the rows of its keys, the counts' prefix sums give every partition the exact
offset at which its first key goes on, and with them every row gets its exact number within its key
(``number_rows``). Row numbers cut each key into equal-sized chunks, which are processed where they lie and merged
by their ordered boundary states (``key_states``). Nothing that is broadcast or held by one task is larger than one
row for each partition.

Ties: give an ``order`` that ends in a unique column. Range partitioning can't cut between equal rows, so equal
rows of one (key, order) would stay together; the numbering would still be exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace


def changed(columns: Sequence[pa.Array], n: int) -> np.ndarray:
    """True where a row differs from the row before it in any of the columns; row 0 is False. Null equals null, NaN equals NaN."""
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        ne = pc.not_equal(a, b)
        if pa.types.is_floating(c.type):
            ne = pc.and_kleene(ne, pc.invert(pc.and_kleene(pc.is_nan(a), pc.is_nan(b))))
        ne = pc.if_else(pc.is_null(ne), pc.xor(pc.is_null(a), pc.is_null(b)), ne)
        out[1:] |= np.asarray(ne.to_numpy(zero_copy_only=False), dtype=bool)
    return out


def _same(a: tuple | None, b: tuple) -> bool:
    return a is not None and all(x == y or (x is None and y is None) or (x != x and y != y) for x, y in zip(a, b))


def _arrays(batch: pa.RecordBatch, names: Sequence[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


#: Bytes of input, as they lie in files, for each sorted run, and the most runs.
RUN_BYTES, MOST_RUNS = 32 << 20, 200_000
#: Chunks of a key whose states are merged at first.
STATES = 1000


def partitions_for(df: DataFrame) -> int:
    """Runs for a table: by the optimizer's estimate of its size, never fewer than the session's shuffle partitions. No run is cut off: only their size changes."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # an estimate beyond a hundred petabytes is that of a plan whose size isn't known
    return least if size > 10**17 else max(least, min(-(-size // RUN_BYTES), MOST_RUNS))


def sorted_runs(df: DataFrame, by: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Partitions that are consecutive sorted runs of the whole table."""
    return df.repartitionByRange(partitions or partitions_for(df), *by).sortWithinPartitions(*by)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    ws: Workspace,
    out: str = "row_no",
    value: str | None = None,
    position: tuple[str, str] | None = None,
) -> DataFrame:
    """Adds the exact running total before each row within its key, in the given order.

    Without ``value`` every row counts 1 and ``out`` is the row's number from 0; with ``value`` (an integer
    column, null as 0) it is the exclusive prefix sum. ``keys`` are flat columns and may be empty (one global
    numbering). ``position`` names two more columns: the sorted run of a row and its place there. Null keys form one group. An empty table gives an empty table. ``out`` and names that begin with
    ``_ch_`` must not be columns of ``df``.
    """
    if out in df.columns or any(c.startswith("_ch_") for c in df.columns):
        raise ValueError(f"column {out} or _ch_* exists already")
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    keys = list(keys)
    schema = T.StructType(
        [*df.schema.fields, *(T.StructField(n, t) for n, t in (("_ch_pid", T.IntegerType()), ("_ch_idx", T.LongType()), ("_ch_run", T.LongType()), ("_ch_val", T.LongType()), ("_ch_lead", T.BooleanType())))]
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, idx, run, last, lead = TaskContext.get().partitionId(), 0, 0, None, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = _arrays(b, keys)
            new = changed(cols, n)
            first = tuple(c[0].as_py() for c in cols)
            new[0] = not _same(last, first)
            if new[0]:
                lead, run = last is None, 0
            val = np.ones(n, np.int64) if value is None else np.asarray(pc.fill_null(_arrays(b, [value])[0], 0).cast(pa.int64()))
            total = np.cumsum(val) - val
            starts = np.flatnonzero(new)
            base = np.zeros(n, np.int64)
            base[starts] = total[starts] - np.concatenate([[0], total[starts[:-1]]]) if len(starts) else 0
            base = np.cumsum(base)
            local_run = total - base
            upto = starts[1] if len(starts) > 1 and new[0] else (starts[0] if len(starts) and not new[0] else n)
            local_run[:upto] += run
            is_lead = np.zeros(n, bool)
            if lead:
                is_lead[:upto] = True
                lead = upto == n
            run, last = int(local_run[-1] + val[-1]), tuple(c[n - 1].as_py() for c in cols)
            extra = [pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(idx, idx + n)), pa.array(local_run), pa.array(val), pa.array(is_lead)]
            idx += n
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "_ch_pid", "_ch_idx", "_ch_run", "_ch_val", "_ch_lead"])

    runs = ws.table(sorted_runs(df, by).mapInArrow(local, schema), "runs")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    states = runs.groupBy("_ch_pid").agg(
        F.min_by(key, "_ch_idx").alias("first"),
        F.max_by(key, "_ch_idx").alias("last"),
        F.max_by(F.col("_ch_run") + F.col("_ch_val"), "_ch_idx").alias("tail"),
        F.bool_and("_ch_lead").alias("whole"),
    )

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tail = None, 0
        for f in frames:
            pids, carries = [], []
            for r in f.itertuples(index=False):
                first, end = tuple(r.first.values()), tuple(r.last.values())
                c = tail if _same(last, first) else 0
                pids.append(r[0])
                carries.append(c)
                last, tail = end, r.tail + (c if r.whole else 0)
            yield pd.DataFrame({"_ch_pid": pids, "_ch_carry": carries})

    # one row for each partition: the prefix sums are one short task, and broadcasting them is bounded by the partition count
    ordered = states.coalesce(1).sortWithinPartitions("_ch_pid").withColumnRenamed("_ch_pid", "pid")
    carries = ordered.select("pid", "first", "last", "tail", "whole").mapInPandas(carry, "_ch_pid int, _ch_carry long")
    joined = runs.join(F.broadcast(carries), "_ch_pid", "left")
    place = [F.col("_ch_pid").alias(position[0]), F.col("_ch_idx").alias(position[1])] if position else []
    numbered = joined.select(*[F.col(f"`{c}`") for c in df.columns], *place, (F.col("_ch_run") + F.when(F.col("_ch_lead"), F.coalesce("_ch_carry", F.lit(0))).otherwise(0)).alias(out))
    # ws.drop of the result removes the runs, once it has been written
    numbered._quadloom_path = runs._quadloom_path
    return numbered


def key_states(df: DataFrame, keys: Sequence[str], distinct: Sequence[str], low_high: str, tie: str, ws: Workspace, chunk_rows: int = 100_000) -> DataFrame:
    """Per key: rows, lowest and highest of a timestamp or integer column, exact distinct count of a group of columns.

    Rows are numbered within their key in the order of (``distinct``, ``tie``); chunk i of a key holds its rows
    i * chunk_rows and following. A task reads what lies in its files and gives each chunk, or the part of it that
    it has, a boundary state: first row, rows, low, high, distinct values, first and last value. A key that begins
    and ends within a file is final there. The other states, at most two for each file and one for each chunk of a
    hot key, are merged in the order of their row numbers: where one begins with the value at which the one before
    ended, the value counts once.

    A null ``low_high`` is left out of low and high. A value whose columns are all null isn't counted as distinct;
    null keys form one group. Repeated rows all count in ``n_rows``. Columns that aren't named are dropped, so names
    that clash can't matter.
    """
    keys, distinct = list(keys), list(distinct)
    lh = dict(df.dtypes)[low_high]
    at = F.col(low_high).cast("timestamp") if lh == "timestamp_ntz" else F.col(low_high)
    at = F.unix_micros(at) if lh.startswith("timestamp") else at.cast("long")
    names = [f"k{i}" for i in range(len(keys))] + [f"d{i}" for i in range(len(distinct))]
    slim = df.select(*[F.col(c).alias(n) for c, n in zip([*keys, *distinct], names)], at.alias("at"), F.col(tie).alias("tie"))
    kn, dn = names[: len(keys)], names[len(keys) :]
    numbered = number_rows(slim, kn, [*dn, "tie"], ws, out="row_no", position=("pid", "idx"))
    kf, df_ = [slim.schema[n] for n in kn], [slim.schema[n] for n in dn]
    schema = T.StructType(
        [*kf, *(T.StructField(n, T.LongType()) for n in ("first_row", "n", "lo", "hi", "d")), T.StructField("open", T.BooleanType()), *(T.StructField(f"{w}_{x.name}", x.dataType) for w in ("f", "l") for x in df_)]
    )
    big = np.iinfo(np.int64).max

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        pending: dict | None = None

        def emit(rows: list[dict]) -> pa.RecordBatch:
            out = []
            for r in rows:
                lo, hi = (None, None) if r["lo"] == big else (r["lo"], r["hi"])
                ends = (*r["first"], *r["last"]) if r["open"] else (None,) * (2 * len(df_))
                out.append((*r["key"], r["row"], r["n"], lo, hi, r["d"], r["open"], *ends))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(target)], schema=target)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            kc, dc = _arrays(b, kn), _arrays(b, dn)
            row, pid, idx = (np.asarray(x) for x in _arrays(b, ["row_no", "pid", "idx"]))
            piece = np.ones(n, bool)  # a row that doesn't follow the one before in the sorted run
            piece[1:] = (pid[1:] != pid[:-1]) | (idx[1:] != idx[:-1] + 1)
            new_key = piece | changed(kc, n)
            new_state = new_key | (row % chunk_rows == 0)
            new_state[0] = True
            new_val = new_state | changed(dc, n)
            known = np.zeros(n, bool)
            for c in dc:
                known |= ~np.asarray(c.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            starts = np.flatnonzero(new_state)
            ends = np.append(starts[1:], n) - 1
            ts = _arrays(b, ["at"])[0]
            absent = np.asarray(ts.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            tv = np.asarray(pc.fill_null(ts, 0))
            lo = np.minimum.reduceat(np.where(absent, big, tv), starts)
            hi = np.maximum.reduceat(np.where(absent, -big, tv), starts)
            cnt, dist = ends - starts + 1, np.add.reduceat((new_val & known).astype(np.int64), starts)
            # whole keys: they begin with row 0 and another key follows them in the run
            whole = np.zeros(len(starts), bool)
            whole[:-1] = (row[starts[:-1]] == 0) & new_key[starts[1:]] & ~piece[starts[1:]]

            def state(i: int) -> dict:
                s, e = int(starts[i]), int(ends[i])
                return {"key": tuple(c[s].as_py() for c in kc), "row": int(row[s]), "n": int(cnt[i]), "lo": int(lo[i]), "hi": int(hi[i]), "d": int(dist[i]), "open": not whole[i], "first": tuple(c[s].as_py() for c in dc), "last": tuple(c[e].as_py() for c in dc), "pid": int(pid[e]), "idx": int(idx[e])}

            m, skip, done = len(starts), 0, []
            if pending is not None:
                follows = pending["pid"] == pid[0] and pending["idx"] + 1 == idx[0]
                same = _same(pending["key"], tuple(c[0].as_py() for c in kc))
                if follows and same and row[0] % chunk_rows:
                    h = state(0)
                    again = _same(pending["last"], h["first"]) and any(x is not None for x in h["first"])
                    merged = h | {"row": pending["row"], "n": pending["n"] + h["n"], "lo": min(pending["lo"], h["lo"]), "hi": max(pending["hi"], h["hi"]), "d": pending["d"] + h["d"] - again, "first": pending["first"]}
                    merged["open"] = not (m > 1 and merged["row"] == 0 and new_key[starts[1]] and not piece[starts[1]])
                    skip = 1
                    if m > 1:
                        done.append(merged)
                    pending = merged
                else:
                    done.append(pending | {"open": not (pending["row"] == 0 and follows and not same)})
            if m > skip:
                inner = np.arange(skip, m - 1)
                done += [state(i) for i in inner[~whole[inner]]]
                w = inner[whole[inner]]
                if len(w):
                    at_ = pa.array(starts[w])
                    void = lo[w] == big
                    cols = [c.take(at_) for c in kc] + [pa.array(np.zeros(len(w), np.int64)), pa.array(cnt[w].astype(np.int64)), pa.array(lo[w], mask=void), pa.array(hi[w], mask=void), pa.array(dist[w]), pa.array(np.zeros(len(w), bool))]
                    cols += [pa.nulls(len(w), f.type) for f in list(target)[-2 * len(df_) :]]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)
                pending = state(m - 1)
            if done:
                yield emit(done)
        if pending is not None:
            yield emit([pending | {"open": True}])

    from pyspark.sql import Window as W

    table = ws.table(numbered.drop("tie").mapInArrow(states, schema), "states")
    ws.drop(numbered)
    final = table.where("NOT open").select(*kn, "n", "lo", "hi", "d", F.lit(1).alias("chunks"))
    some = F.coalesce(*[F.col(f"f_{n}").cast("string") for n in dn]).isNotNull()
    ends = {x: F.struct(*[F.col(f"{x}_{n}").alias(n) for n in dn]) for x in ("f", "l")}

    def merge(rows: DataFrame, by: list[str]) -> DataFrame:
        """Neighbouring states of a key to one, in the order of their rows."""
        w = W.partitionBy(*kn, *by).orderBy("first_row")
        twice = rows.withColumn("twice", (F.lag(ends["l"]).over(w).eqNullSafe(ends["f"]) & some).cast("long"))
        at_ends = [F.min_by(f"f_{n}", "first_row").alias(f"f_{n}") for n in dn] + [F.max_by(f"l_{n}", "first_row").alias(f"l_{n}") for n in dn]
        return twice.groupBy(*kn, *by).agg(F.min("first_row").alias("first_row"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("d") - F.coalesce(F.sum("twice"), F.lit(0))).alias("d"), F.sum("chunks").cast("int").alias("chunks"), *at_ends)

    # a hot key has a state a chunk: stretches of it are merged first, so that no task gets them all
    stretches = merge(table.where("open").withColumns({"stretch": F.floor(F.col("first_row") / (chunk_rows * STATES)), "chunks": F.lit(1)}), ["stretch"])
    merged = merge(stretches, []).select(*kn, "n", "lo", "hi", "d", "chunks")
    back = (lambda c: F.timestamp_micros(c).cast("timestamp_ntz")) if lh == "timestamp_ntz" else (lambda c: F.timestamp_micros(c)) if lh == "timestamp" else (lambda c: F.col(c).cast(lh))
    return final.unionByName(merged).select(*[F.col(n).alias(k) for n, k in zip(kn, keys)], F.col("n").alias("n_rows"), back("lo").alias("lowest"), back("hi").alias("highest"), F.col("d").alias("n_distinct"), F.col("chunks").alias("n_chunks"))
