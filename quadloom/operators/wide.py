"""Attribute-value statements to typed wide rows by log-structured upserts.

Every task turns the statements it reads into runs of sparse wide deltas: one row per subject whose map holds, for each
declared column, the cell's state with its own version. Runs are written sorted by subject. Compaction shuffles the
sparse rows once and merges any number of sorted runs: per cell the latest version wins and the states of all versions
combine, so batches may come late, twice or in any order and give the same table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.xsd import canonical, typed
from ..workspace import Workspace

#: Statements that a task gathers before it cuts a run off, and sparse rows that it sends on at once.
HELD, ROWS = 1 << 18, 4096
CELL = "struct<at:timestamp_ntz,row_id:bigint,val:string,n_rows:bigint,n_fit:bigint,differs:boolean>"
RUN = f"batch string, subj string, cells map<string,{CELL}>"
CELL_ARROW = pa.struct([("at", pa.timestamp("us")), ("row_id", pa.int64()), ("val", pa.string()), ("n_rows", pa.int64()), ("n_fit", pa.int64()), ("differs", pa.bool_())])
MAP_ARROW = pa.map_(pa.string(), CELL_ARROW)


def declared(predicates: DataFrame) -> list[tuple[str, str, str]]:
    """(predicate, value type, column name) of the declaration table, whose rows are the columns of the wide table: a schema, read by the driver.

    Rows with a null are left out; of repeated predicates the first in order is kept; a column name that is taken
    (without case) gets a number.
    """
    rows = sorted({(r.p, r.value_type, r.col_name) for r in predicates.select("p", "value_type", "col_name").where("p IS NOT NULL AND value_type IS NOT NULL AND col_name IS NOT NULL").collect()})
    out: list[tuple[str, str, str]] = []
    for p, t, c in rows:
        if p in {x[0] for x in out}:
            continue
        taken, name, i = {x[2].lower() for x in out}, c, 1
        while name.lower() in taken:
            i += 1
            name = f"{c}_{i}"
        out.append((p, t, name))
    return out


def _fitting(columns: list[tuple[str, str, str]]) -> Column:
    """The canonical text of o for the type that p declares; null if o doesn't fit."""
    by_type: dict[str, list[str]] = {}
    for p, t, _ in columns:
        by_type.setdefault(t, []).append(p)
    out = F.lit(None).cast("string")
    for t, ps in by_type.items():
        fits = F.when(F.col("o.k") == (1 if t.endswith("anyURI") else 2), canonical(F.col("o.v"), t))
        out = F.when(F.col("p").isin(ps), fits).otherwise(out)
    return out


def deltas(statements: DataFrame, columns: list[tuple[str, str, str]], batch: Column | None = None) -> DataFrame:
    """Sparse wide deltas (batch, subj, cells), without a shuffle: cells maps a column name to its state.

    Every task gathers the statements it reads in a table of its own that is cut off, sorted by subject, at ``HELD`` statements and
    at its end: the runs of the log. ``batch`` numbers them. A cell's state is the version (loaded_at, row_id) of its value, the
    value of the latest version that fits, the numbers of statements and of fitting ones, and whether a version of
    another value lies under it. A null loaded_at is the oldest version. Statements of undeclared predicates, and with
    null s or p, belong to no cell; those whose object is null or doesn't fit only count in n_rows. Repeated
    statements change nothing but the counts. ``batch`` may give a column of batches that are kept apart.
    """
    names = F.create_map(*[F.lit(x) for p, _, c in columns for x in (p, c)]) if columns else F.lit(None).cast("map<string,string>")
    oldest = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    rows = statements.where(F.col("p").isin([p for p, _, _ in columns]) & F.col("s.v").isNotNull())
    flat = rows.select(
        (batch.cast("string") if batch is not None else F.lit(None).cast("string")).alias("batch"), F.col("s.v").alias("subj"), names[F.col("p")].alias("col"),
        F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), oldest).alias("at"), F.col("row_id"), _fitting(columns).alias("val"),
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, run, task = 0, 0, TaskContext.get().partitionId()
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                yield from _run_of(pa.Table.from_batches(held), f"{task}-{run}")
                held, size, run = [], 0, run + 1
        if size:
            yield from _run_of(pa.Table.from_batches(held), f"{task}-{run}")

    return flat.mapInArrow(gather, RUN)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a text column that order as its texts do, and the texts in that order."""
    d = column.combine_chunks().dictionary_encode() if isinstance(column, pa.ChunkedArray) else column.dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    order = np.asarray(pc.sort_indices(d.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[np.asarray(d.indices)], d.dictionary.take(pa.array(order))


def _latest(groups: list[np.ndarray], at: np.ndarray, row: np.ndarray, val: pa.Array, n_rows: np.ndarray, n_fit: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Versions of cells in order and, for every cell, the place of its latest fitting version (else of its latest) and the state of all."""
    fits = np.asarray(val.is_valid().to_numpy(zero_copy_only=False), bool)
    order = np.lexsort((row, at, fits, *reversed(groups)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[order[1:]] != g[order[:-1]]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(order)) - 1
    # a value that the version before it in the cell doesn't have; two different values can't avoid it
    code = np.asarray(val.dictionary_encode().indices.fill_null(-1))[order]
    other = np.zeros(len(order), bool)
    other[1:] = ~new[1:] & (code[1:] != code[:-1]) & (code[:-1] >= 0)
    total = lambda x: np.add.reduceat(x[order], starts) if len(starts) else x[:0]
    some = np.add.reduceat((other | differs[order]).astype(np.int64), starts) > 0 if len(starts) else other
    return order[ends], order[starts], total(n_rows), total(n_fit), some


def _sparse(batch: pa.Array, subj: pa.Array, offsets: np.ndarray, cells: dict[str, pa.Array]) -> pa.RecordBatch:
    entry = pa.StructArray.from_arrays([cells[f.name] for f in CELL_ARROW], fields=list(CELL_ARROW))
    maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), cells["col"], entry)
    return pa.RecordBatch.from_arrays([batch, subj, maps], names=["batch", "subj", "cells"])


def _emit(batch: pa.Array | None, batch_text: str, subj: np.ndarray, subjects: pa.Array, apart: np.ndarray, col: pa.Array, cells: tuple, at: np.ndarray, row: pa.Array, val: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of one subject each, from cells in the order of (batch, subject, column)."""
    pick, _, n_rows, n_fit, some = cells
    s, g = subj[pick], apart[pick]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])])) if len(s) else np.zeros(0, np.int64)
    take = pa.array(pick)
    states = {"col": col.take(take), "at": pa.array(at[pick], pa.timestamp("us")), "row_id": row.take(take), "val": val.take(take), "n_rows": pa.array(n_rows), "n_fit": pa.array(n_fit), "differs": pa.array(some)}
    for i in range(0, len(first), ROWS):
        part = first[i : i + ROWS]
        end = first[i + ROWS] if i + ROWS < len(first) else len(s)
        cut = {k: v.slice(part[0], end - part[0]) for k, v in states.items()}
        texts = pa.array([batch_text] * len(part)) if batch is None else batch.take(pa.array(pick[part]))
        yield _sparse(texts, subjects.take(pa.array(s[part])), np.append(part, end) - part[0], cut)


def _run_of(t: pa.Table, name: str) -> Iterator[pa.RecordBatch]:
    """A run of a task's statements: sparse rows sorted by subject."""
    t = t.combine_chunks()
    column = lambda n: t.column(n).combine_chunks()
    given = column("batch")
    subj, subjects = _codes(column("subj"))
    col, cols = _codes(column("col"))
    apart = _codes(given.fill_null(""))[0]
    at, row, val = np.asarray(column("at").cast(pa.int64())), column("row_id"), column("val")
    val = val if isinstance(val, pa.Array) else val.combine_chunks()
    ids = np.asarray(pc.fill_null(row.cast(pa.int64()), np.iinfo(np.int64).min))
    one = np.ones(len(subj), np.int64)
    fit = np.asarray(val.is_valid().to_numpy(zero_copy_only=False)).astype(np.int64)
    cells = _latest([subj, apart, col], at, ids, val, one, fit, np.zeros(len(subj), bool))
    yield from _emit(None if given.null_count == len(given) else given, name, subj, subjects, apart, cols.take(pa.array(col)), cells, at, row.cast(pa.int64()), val)


def write_run(delta: DataFrame, ws: Workspace) -> DataFrame:
    """Runs of the log as they were made: one or more in every file, each sorted by subject."""
    return ws.table(delta, "run")


def compact(runs: list[DataFrame], partitions: int | None = None) -> DataFrame:
    """Merges runs into one row per subject; the result is again a run (batch "compacted") that later deltas can join.

    The sparse rows are shuffled once, by subject. A task merges its runs in the order of subjects and keeps, for each cell, the
    latest version that fits; what the versions under it differ in is the cell's fault. A subject has one row a
    run, so a hot one is as many rows as there are runs, and its versions are merged as they come, never gathered.
    """
    log = reduce(DataFrame.unionByName, [r.select("subj", "cells") for r in runs])
    placed = (log.repartition(partitions, "subj") if partitions else log.repartition("subj")).sortWithinPartitions("subj")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.RecordBatch | None = None  # the subject at hand
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(MAP_ARROW)], names=["subj", "cells"])
            rows = b if open_ is None else pa.Table.from_batches([open_, b]).combine_chunks().to_batches()[0]
            out = list(_merged(rows))
            last = out[-1]
            yield from out[:-1]
            if last.num_rows > 1:
                yield last.slice(0, last.num_rows - 1)
            open_ = last.slice(last.num_rows - 1).select(["subj", "cells"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["compacted"]), open_.column(0), open_.column(1)], names=["batch", "subj", "cells"])

    return placed.mapInArrow(merge, RUN)


def _merged(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows sorted by subject to one row per subject."""
    maps = b.column(1)
    offsets = np.asarray(maps.offsets)
    owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    low, high = int(offsets[0]), int(offsets[-1])
    cell = maps.items.slice(low, high - low)
    subj, subjects = _codes(b.column(0))
    col, cols = _codes(maps.keys.slice(low, high - low))
    get = lambda n: cell.field(n) if cell.offset == 0 and len(cell) == len(cell.field(n)) else pc.struct_field(cell, n)
    at, row, val = np.asarray(get("at").cast(pa.int64())), get("row_id"), get("val")
    ids = np.asarray(pc.fill_null(row, np.iinfo(np.int64).min))
    subj = subj[owner]
    differs = np.asarray(get("differs").to_numpy(zero_copy_only=False), bool)
    cells = _latest([subj, col], at, ids, val, np.asarray(get("n_rows")), np.asarray(get("n_fit")), differs)
    yield from _emit(None, "compacted", subj, subjects, np.zeros(len(subj), np.int64), cols.take(pa.array(col)), cells, at, row, val)


def wide(run: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """Typed columns of a compacted run; a cell without a fitting value is null."""
    return run.select("subj", *[typed(F.col("cells")[c]["val"], t).alias(c) for _, t, c in columns])


def cell_faults(run: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """(subj, pred, kind) of a compacted run: an 'untypable' cell has no version with a fitting value, a 'conflict' one versions of different values."""
    back = F.create_map(*[F.lit(x) for p, _, c in columns for x in (c, p)]) if columns else F.lit(None).cast("map<string,string>")
    flat = run.select("subj", F.explode("cells").alias("col", "cell"))
    kind = F.when(F.col("cell.val").isNull(), F.lit("untypable")).when(F.col("cell.differs"), F.lit("conflict"))
    return flat.select("subj", back[F.col("col")].alias("pred"), kind.alias("kind")).where("kind IS NOT NULL")
