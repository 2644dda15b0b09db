"""python -m quadloom --query QUERY --in FILES --out FOLDER: runs a query over RDF files and writes JSON lines."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .graph import Graph
    from .sources.rdf import read_rdf

    a = argparse.ArgumentParser(prog="quadloom")
    a.add_argument("--query", required=True)
    a.add_argument("--in", dest="source", required=True, help="path or glob; several are separated by commas")
    a.add_argument("--out", required=True)
    a.add_argument("--mode", default="FAILFAST")
    args = a.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    Graph(read_rdf(spark, args.source.split(","), args.mode)).sparql(args.query).json().write.text(args.out)


if __name__ == "__main__":
    main()
