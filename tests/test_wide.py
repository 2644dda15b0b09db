import random
from datetime import datetime, timedelta

from quadloom.functions.xsd import canonical, typed, valid
from quadloom.operators import wide as W
from pyspark.sql import functions as F

T = "struct<k:tinyint,v:string,dt:string,lang:string>"
SCHEMA = f"row_id long, s {T}, p string, o {T}, g {T}, loaded_at timestamp_ntz"
PRED = [("p:i", "xsd:integer", "i"), ("p:d", "xsd:dateTime", "d"), ("p:t", "xsd:string", "t"), ("p:u", "xsd:anyURI", "u"), (None, "xsd:string", "x"), ("p:i", "xsd:string", "again")]


def term(v, k=2):
    return (k, v, "xsd:string" if k == 2 else None, None)


def run(spark, ws, rows, split=None):
    cols = W.declared(spark.createDataFrame(PRED, "p string, value_type string, col_name string"))
    parts = split or [rows]
    runs = [W.write_run(W.deltas(spark.createDataFrame(x, SCHEMA), cols), ws) for x in parts]
    return W.compact(runs), cols


def test_latest_fitting_value_and_faults(spark, ws):
    t0 = datetime(2025, 1, 1)
    rows = [
        (1, term("a", 1), "p:i", term(" 07 "), None, t0), (2, term("a", 1), "p:i", term("+7"), None, t0 + timedelta(1)), (3, term("a", 1), "p:i", term("x"), None, t0 + timedelta(2)),
        (4, term("a", 1), "p:d", term("2024-01-01T00:00:00Z"), None, None), (5, term("a", 1), "p:d", term("2023-12-31T23:00:00.50-01:00"), None, t0),
        (6, term("b", 1), "p:t", term("x"), None, t0), (7, term("b", 1), "p:t", term("x"), None, t0), (8, term("b", 1), "p:u", term("lit"), None, t0), (9, term("b", 1), "p:u", None, None, t0),
        (10, None, "p:i", term("1"), None, t0), (11, term("c", 1), None, term("1"), None, t0), (12, term("c", 1), "p:none", term("1"), None, t0),
    ]
    table, cols = run(spark, ws, rows)
    got = {r.subj: r for r in W.wide(table, cols).collect()}
    assert set(got) == {"a", "b"} and got["a"].i == 7 and got["b"].t == "x" and got["b"].u is None
    assert got["a"].d == datetime(2024, 1, 1, 0, 0, 0, 500000)
    assert {tuple(r) for r in W.cell_faults(table, cols).collect()} == {("a", "p:d", "conflict"), ("b", "p:u", "untypable")}
    empty, cols = run(spark, ws, [])
    assert W.wide(empty, cols).count() == 0 and W.cell_faults(empty, cols).count() == 0


def test_declarations(spark):
    rows = [("p:b", "xsd:string", "X"), ("p:a", "xsd:string", "x"), ("p:a", "xsd:integer", "y"), (None, "xsd:string", "z"), ("p:c", None, "z")]
    assert W.declared(spark.createDataFrame(rows, "p string, value_type string, col_name string")) == [("p:a", "xsd:integer", "y"), ("p:b", "xsd:string", "X")]
    rows = [("p:b", "xsd:string", "X"), ("p:a", "xsd:string", "x")]
    assert [c for _, _, c in W.declared(spark.createDataFrame(rows, "p string, value_type string, col_name string"))] == ["x", "X_2"]


def test_batches_in_any_order_give_the_same_table(spark, ws):
    rnd = random.Random(2)
    t0 = datetime(2025, 1, 1)
    rows = [(i, term(rnd.choice(["hot", "hot", f"s{rnd.randrange(20)}"]), 1), rnd.choice(["p:i", "p:t", "p:u"]), term(str(rnd.randrange(4)), rnd.choice([1, 2])), None, t0 + timedelta(hours=rnd.randrange(200))) for i in range(600)]
    one, cols = run(spark, ws, rows)
    cut = [rows[400:], rows[:200], rows[200:400], rows[:200]]
    many, _ = run(spark, ws, rows, cut)
    assert sorted(map(str, W.wide(one, cols).collect())) == sorted(map(str, W.wide(many, cols).collect()))
    assert {tuple(r) for r in W.cell_faults(one, cols).collect()} == {tuple(r) for r in W.cell_faults(many, cols).collect()}
    latest = {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        if r[2] == "p:i" and r[3][0] == 2:
            latest[r[1][1]] = int(r[3][1])
    assert {r.subj: int(r.i) for r in W.wide(one, cols).collect() if r.i is not None} == latest


CASES = {
    "integer": (["7", "+07", " 7\n", "-0", "0", "00", "-12"], ["", "7.0", "٧", "1 2", "--1", "0x1", "1e2"]),
    "decimal": (["1.50", "+1.5", "01.5", ".5", "5.", "-0.0"], [".", "1e3", "INF", "1,5", "1.2.3"]),
    "double": (["1e3", "1000", "INF", "+INF", "-INF", "NaN", "-0", "0.0E0", "1e400"], ["nan", "Infinity", "e5", "1e", "1.0f"]),
    "boolean": (["true", "1", " false ", "0"], ["True", "yes", "", "2"]),
    "date": (["2020-02-29", "2020-02-29Z", "2020-02-29+14:00", "-0044-03-15", "12020-02-29"], ["2021-02-29", "1900-02-29", "2020-4-1", "2020-04-31", "2020-02-29+14:01", "02020-02-29", "20-01-01"]),
    "dateTime": (["2020-02-29T24:00:00", "2020-03-01T00:00:00Z", "2020-03-01T02:00:00.000+02:00", "2020-03-01T00:00:00.1230"], ["2020-03-01", "2020-03-01T25:00:00", "2020-03-01T24:00:01", "2020-03-01 00:00:00", "2020-03-01T00:00:00+2"]),
}


def test_lexical_forms(spark):
    for kind, (good, bad) in CASES.items():
        df = spark.createDataFrame([(x,) for x in good + bad], "v string").select("v", canonical(F.col("v"), f"xsd:{kind}").alias("c"))
        got = {r.v: r.c for r in df.collect()}
        assert all(got[x] is not None and valid(kind, x) for x in good), (kind, got)
        assert all(got[x] is None and not valid(kind, x) for x in bad), (kind, got)
    same = lambda kind, *xs: len({r.c for r in spark.createDataFrame([(x,) for x in xs], "v string").select(canonical(F.col("v"), kind).alias("c")).collect()}) == 1
    assert same("integer", "7", "+07", " 7\n") and same("integer", "0", "-0", "00") and same("decimal", "1.50", "+1.5", "01.5") and same("double", "1e3", "1000", "1.0E3")
    assert same("dateTime", "2020-02-29T24:00:00", "2020-03-01T00:00:00Z", "2020-03-01T02:00:00.000+02:00") and same("date", "2020-02-29", "2020-02-29Z") and not same("date", "2020-02-29", "2020-02-28")
    assert not same("dateTime", "2020-03-01T00:00:00.1", "2020-03-01T00:00:00.01")
    row = spark.sql("SELECT '1.5' AS a, '2020-03-01' AS b").select(typed(canonical(F.col("a"), "decimal"), "decimal").alias("a"), typed(canonical(F.col("b"), "date"), "date").alias("b")).first()
    assert str(row.a).startswith("1.5") and str(row.b) == "2020-03-01"


def test_derived_types():
    assert valid("byte", "-128") and not valid("byte", "128") and valid("nonNegativeInteger", "0") and not valid("positiveInteger", "0") and valid("unsignedLong", "18446744073709551615")
    assert valid("duration", "P1DT2H") and not valid("duration", "P") and not valid("duration", "P1DT") and valid("gYear", "2020") and valid("hexBinary", "0aFF") and not valid("hexBinary", "0") and valid("string", "anything")
