import random
from datetime import datetime, timedelta

import pytest

from quadloom.operators import chunks as C


def rows(n=4000):
    rnd = random.Random(5)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, f"k{rnd.randrange(300)}"])
        at = None if rnd.random() < 0.1 else datetime(2025, 1, 1) + timedelta(seconds=rnd.randrange(10**6))
        out.append((i, key, rnd.choice([None, "x", "y", f"v{rnd.randrange(50)}"]), rnd.choice([None, "d"]), at, rnd.choice([None, 1, 5])))
    return out


SCHEMA = "id long, key string, a string, b string, at timestamp_ntz, w long"


def test_numbers_and_prefix_sums(spark, ws):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = {r.id: (r.row_no, r.total) for r in C.number_rows(C.number_rows(df, ["key"], ["id"], ws), ["key"], ["id"], ws, out="total", value="w").collect()}
    seen = {}
    for r in sorted(data):
        n, t = seen.get(r[1], (0, 0))
        assert got[r[0]] == (n, t)
        seen[r[1]] = (n + 1, t + (r[5] or 0))


def test_global_numbers_ties_and_clash(spark, ws):
    df = spark.createDataFrame([(1,)] * 20 + [(2,)] * 5, "x int")
    got = sorted((r.x, r.n) for r in C.number_rows(df, [], ["x"], ws, out="n").collect())
    assert [n for _, n in got] == list(range(25))
    with pytest.raises(ValueError):
        C.number_rows(df, [], ["x"], ws, out="x")
    assert C.number_rows(df.limit(0), ["x"], ["x"], ws).count() == 0


@pytest.mark.parametrize("batch, chunk", [(7, 100_000), (10_000, 100_000), (10_000, 10), (7, 9), (50, 1)])
def test_key_states(spark, ws, batch, chunk):
    data = rows() + [(10**6 + i, "hot", "x", None, None, None) for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, "extra") for r in data], SCHEMA + ", n string").repartition(5)
        got = {r.key: tuple(r)[1:5] for r in C.key_states(df, ["key"], ["a", "b"], "at", "id", ws, chunk).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in data:
        want.setdefault(r[1], []).append(r)
    assert set(got) == set(want)
    for k, rs in want.items():
        at = [r[4] for r in rs if r[4]]
        assert got[k] == (len(rs), min(at, default=None), max(at, default=None), len({(r[2], r[3]) for r in rs if r[2] or r[3]}))


def test_key_states_empty_and_integers(spark, ws):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, None), ("b", None, None)], "k string, v int, m long").selectExpr("*", "monotonically_increasing_id() AS id")
    got = {r.k: tuple(r)[1:5] for r in C.key_states(df, ["k"], ["v"], "m", "id", ws).collect()}
    assert got == {"a": (2, 5, 5, 1), "b": (1, None, None, 0)}
    assert C.key_states(df.limit(0), ["k"], ["v"], "m", "id", ws).count() == 0
