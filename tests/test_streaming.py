import pytest
from pyspark.sql import functions as F

from quadloom.operators import setsketch as S
from quadloom.streaming.continuous import SketchSink, query_stream


def stream(spark, tmp_path, small, parts=3):
    quads = spark.read.parquet(f"{small}/quads.parquet")
    for i in range(parts):
        quads.where(F.pmod("row_id", F.lit(parts)) == i).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return quads, spark.readStream.schema(quads.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stateless_queries(spark, tmp_path, small):
    quads, live = stream(spark, tmp_path, small)
    q = "PREFIX k: <https://voc.kelmar.example/ns#> SELECT ?s ?o { { ?s k:flag ?o } UNION { ?s k:draught ?o FILTER(?o > 3) } }"
    out = query_stream(live, q).writeStream.format("memory").queryName("flags").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    out.awaitTermination(120)
    from quadloom.graph import Graph

    assert sorted(map(str, spark.table("flags").collect())) == sorted(map(str, Graph(quads).sparql(q).terms().collect()))
    with pytest.raises(ValueError):
        query_stream(quads, q)


def test_sketches_of_batches(spark, tmp_path, small):
    quads, live = stream(spark, tmp_path, small)
    add = lambda df: df.select("p", S.hashed(F.col("s.k"), F.col("s.v")).alias("h"))
    sink = SketchSink(str(tmp_path / "out"), ["p"], "h")
    add(live).writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination(120)
    want = {r.p: bytes(r.sketch) for r in S.merge(S.partials(add(quads), ["p"], "h")).collect()}
    assert {r.p: bytes(r.sketch) for r in sink.merged(spark).collect()} == want
    sink(add(quads), 0)  # a repeated batch replaces itself; rows that come twice change nothing
    assert {r.p: bytes(r.sketch) for r in sink.merged(spark).collect()} == want
    assert sink.estimates(spark).count() == len(want)
