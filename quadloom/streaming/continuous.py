"""Queries and distinct counts over streams of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from ..operators import setsketch


def query_stream(quads: DataFrame, query: str) -> DataFrame:
    """Solutions of a query over a streaming DataFrame of quads, as term columns.

    The stateless fragment runs row by row as statements arrive: single triple patterns, FILTER, BIND, UNION, VALUES
    and projection. Spark refuses at the start of the stream what needs state without a watermark, such as DISTINCT,
    aggregates and OPTIONAL.
    """
    if not quads.isStreaming:
        raise ValueError("query_stream takes a streaming DataFrame; use Graph for tables")
    return Graph(quads).sparql(query).terms()


class SketchSink:
    """A ``foreachBatch`` sink that keeps distinct counts of groups as mergeable partial sketches.

    Each batch writes its own partials under its number, so a batch that is repeated after a failure replaces itself
    and counts once. ``merged`` combines all batches by maximum; late rows need no watermark.
    """

    def __init__(self, path: str, keys: list[str], hash_col: str, config: setsketch.Config = setsketch.Config()):
        self.path, self.keys, self.hash_col, self.config = path.rstrip("/"), keys, hash_col, config

    def __call__(self, batch: DataFrame, number: int) -> None:
        parts = setsketch.merge(setsketch.partials(batch, self.keys, self.hash_col, self.config), self.config)
        parts.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def merged(self, spark: SparkSession) -> DataFrame:
        return setsketch.merge(spark.read.parquet(self.path).drop("batch"), self.config)

    def estimates(self, spark: SparkSession) -> DataFrame:
        return setsketch.estimates(self.merged(spark), self.config)
