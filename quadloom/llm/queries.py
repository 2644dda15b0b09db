"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..workspace import Workspace
from . import leakage, packing, stuffing


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "packing")
    counts = ws.table(packing.token_counts(_read(spark, d, "documents")), "counts")
    return packing.pack(counts, _read(spark, d, "capacities"), ws)


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p6_packed(spark, d), _read(spark, d, "capacities"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_read(spark, d, "documents"), _read(spark, d, "heldout"))


def p7_containment(spark: SparkSession, d: str) -> DataFrame:
    """How much of each leaked item a document holds."""
    return leakage.containments(_read(spark, d, "documents"), _read(spark, d, "heldout"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.find_stuffed(_read(spark, d, "documents"), Workspace(spark, "stuffing"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The spam share of every document."""
    ws = Workspace(spark, "stuffing")
    feats = ws.table(stuffing.block_features(_read(spark, d, "documents")), "features")
    return stuffing.judge(feats, ws.table(stuffing.calibrate(feats), "thresholds"))


QUERIES = {f.__name__: f for f in (p6_packed, p6_summary, p7_found, p7_containment, p8_found, p8_scores)}
SQL: dict[str, str] = {}
