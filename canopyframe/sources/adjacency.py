"""Square 0/1 region matrix -> edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def adjacency_edges(wide: DataFrame, row_name: str | None = None) -> DataFrame:
    """Ordered pairs (``region_a``, ``region_b``) of a matrix whose first column names the rows.

    Column names are taken from the header, so pairs keep the full coded region names.
    """
    name = row_name or wide.columns[0]
    values = [c for c in wide.columns if c != name]
    return (
        wide.select(F.col(f"`{name}`").alias("region_a"),
                    *[F.col(f"`{c}`").cast("int").alias(c) for c in values])
        .unpivot(["region_a"], [F.col(f"`{c}`") for c in values], "region_b", "adjacent")
        .filter(F.col("adjacent") == 1)
        .select("region_a", "region_b")
    )


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    wide = spark.read.option("header", "true").csv(path)
    return adjacency_edges(wide)
