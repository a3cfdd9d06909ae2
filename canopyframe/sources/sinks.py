"""Writers. Rows are rebalanced on the layout column first: adaptive execution splits a hot value
over several files and merges small ones, so no single task writes a third of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    out = df.orderBy(*sort_by) if sort_by else df
    out.write.mode("overwrite").option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_plot(df: DataFrame, path: str, key: str = "PLT_CN",
                  one_folder_per_plot: bool = False) -> None:
    """Per-plot results as one Parquet table clustered by plot.

    Sorted row groups let a reader skip straight to a plot. ``one_folder_per_plot`` lays out a
    folder per plot instead; it suits a few plots, not a hundred thousand.
    """
    clustered = df.hint("rebalance", key)
    if one_folder_per_plot:
        clustered.write.mode("overwrite").partitionBy(key).parquet(path)
    else:
        clustered.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "PLT_CN") -> None:
    """Per-plot results as a bucketed table, so that later joins on the plot need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_by_state(df: DataFrame, path: str, key: str = "STATECD", fmt: str = "parquet") -> None:
    """One folder per state in a single job."""
    out = df.hint("rebalance", key).write.mode("overwrite").partitionBy(key)
    if fmt == "csv":
        out.option("header", "true").csv(path)
    else:
        out.parquet(path)
