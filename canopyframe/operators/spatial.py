"""Region adjacency restricted to the regions that occur in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMED = 20     # problems that an error names


def regions_in(rows: DataFrame, column: str = "region") -> DataFrame:
    return rows.select(F.col(column).alias("region")).distinct()


def matrix_regions(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("region_a").alias("region")).union(
        edges.select(F.col("region_b").alias("region"))).distinct()


def common_regions(edges: DataFrame, regions: DataFrame) -> DataFrame:
    return matrix_regions(edges).intersect(regions.select("region"))


def restrict_edges(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``regions``."""
    ends = regions.select("region")
    return (
        edges.join(ends.withColumnRenamed("region", "region_a"), on="region_a", how="left_semi")
        .join(ends.withColumnRenamed("region", "region_b"), on="region_b", how="left_semi")
        .select("region_a", "region_b")
    )


def adjacency_problems(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(problem, region) rows: self edges, one-way edges, data regions without any neighbour."""
    inside = restrict_edges(edges, regions)
    loops = inside.filter(F.col("region_a") == F.col("region_b"))
    back = inside.select(F.col("region_b").alias("region_a"), F.col("region_a").alias("region_b"))
    one_way = inside.join(back, on=["region_a", "region_b"], how="left_anti")
    linked = inside.filter(F.col("region_a") != F.col("region_b")).select(
        F.col("region_a").alias("region"))
    unknown = regions.select("region").join(matrix_regions(edges), on="region", how="left_anti")
    alone = (regions.select("region").join(linked, on="region", how="left_anti")
             .join(unknown, on="region", how="left_anti"))

    def labelled(df: DataFrame, problem: str, column: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(column).alias("region"))

    return (
        labelled(loops, "self edge", "region_a")
        .unionByName(labelled(one_way, "one-way edge", "region_a"))
        .unionByName(labelled(unknown, "not in matrix", "region"))
        .unionByName(labelled(alone, "no neighbour", "region"))
        .distinct()
    )


def checked_edges(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Restricted edges, or an error naming what makes them unusable for the spatial model."""
    problems = adjacency_problems(edges, regions).orderBy("problem", "region").take(NAMED + 1)
    if problems:
        rest = "; and more" if len(problems) > NAMED else ""
        raise ValueError("; ".join(f"{p.problem}: {p.region}" for p in problems[:NAMED]) + rest)
    return restrict_edges(edges, regions)
