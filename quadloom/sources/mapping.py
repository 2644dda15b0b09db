"""The test tables as a virtual graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import MappedGraph, Table

#: key columns and links {column: (predicate, table)} of each table
KEYS: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, str]]]] = {
    "region": (("r_regionkey",), {}),
    "nation": (("n_nationkey",), {"n_regionkey": ("n_region", "region")}),
    "customer": (("c_custkey",), {"c_nationkey": ("c_nation", "nation")}),
    "supplier": (("s_suppkey",), {"s_nationkey": ("s_nation", "nation")}),
    "part": (("p_partkey",), {}),
    "orders": (("o_orderkey",), {"o_custkey": ("o_customer", "customer")}),
    "lineitem": (("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), {"l_orderkey": ("l_order", "orders"), "l_partkey": ("l_part", "part"), "l_suppkey": ("l_supplier", "supplier")}),
    "events": (("event_id",), {}),
    "documents": (("doc_id",), {}),
    "heldout": (("item_id",), {}),
}
DEFAULT_GRAPH = ("region", "nation")
LANGUAGES = {"documents": ("text", "lang"), "heldout": ("text", "lang")}


_GRAPHS: dict[tuple, MappedGraph] = {}


def mapped(spark: SparkSession, d: str, tables: list[str] | None = None) -> MappedGraph:
    """The tables of a folder of Parquet files (those named, or all) as a graph; region and nation lie in the default graph."""
    # only schemas are kept: the files are listed once a session
    at = (spark.sparkContext.applicationId, d, tuple(tables or ()))
    if at not in _GRAPHS:
        _GRAPHS[at] = _mapped(spark, d, tables)
    return _GRAPHS[at]


def _mapped(spark: SparkSession, d: str, tables: list[str] | None) -> MappedGraph:
    return MappedGraph({n: Table(spark.read.parquet(f"{d}/{n}.parquet"), k, links, n not in DEFAULT_GRAPH, LANGUAGES.get(n)) for n, (k, links) in KEYS.items() if tables is None or n in tables})
