"""Plot histories: qualifying visits, cumulative flags, one random visit per plot.

Everything that looks along a plot's history works on one row per (plot, year). Tree rows are
first reduced to that grain with map-side combining, so a window over a plot holds as many rows
as it has survey years, however many trees the plot has. Tree rows are joined once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.functions.keys import md5_bits, plot_key
from canopyframe.operators.prep import TREE_JOIN_KEYS
from canopyframe.operators.ranking import number_distinct
from canopyframe.session import materialize

VISIT_KEYS = ["pltID", "INVYR"]
MIN_DIAMETER = 5
FIRST_YEAR = 2001
MIN_TREES = 25
SEED = "01282024"


def measured_trees(trees: DataFrame, min_diameter: float = MIN_DIAMETER,
                   first_year: int = FIRST_YEAR) -> DataFrame:
    """Trees above the sapling diameter from surveys of the consistent design."""
    return (
        trees.filter(F.col("DIA") > min_diameter)
        .filter(F.col("INVYR") >= first_year)
        .dropna(subset=["DIA"])
    )


def group_sizes(trees: DataFrame, min_trees: int = MIN_TREES) -> DataFrame:
    """Visits with at least ``min_trees`` trees and their tree count."""
    return (
        trees.groupBy(*VISIT_KEYS).agg(F.count(F.lit(1)).alias("N_trees"))
        .filter(F.col("N_trees") >= min_trees)
    )


def in_qualifying_groups(trees: DataFrame, min_trees: int = MIN_TREES) -> DataFrame:
    """Trees of qualifying visits with the visit's tree count."""
    return trees.join(group_sizes(trees, min_trees), on=VISIT_KEYS, how="inner")


def visit_table(trees: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per visit with all that the history operators need from its trees.

    ``ticket`` is the smallest hash among the visit's trees: the visit holding a plot's smallest
    ticket is a draw with chances proportional to tree counts, the same for any partitioning.
    """
    ticket = md5_bits(F.lit(seed), F.col("pltID"), F.col("TRE_CN"))
    return trees.groupBy(*VISIT_KEYS).agg(
        F.count(F.lit(1)).alias("N_trees"),
        F.bool_or(F.col("KINDCD") == 3).alias("_replaced"),
        F.bool_or(F.col("Disturbance") != "No").alias("_disturbed"),
        F.min(ticket).alias("ticket"))


def visits_of_trees(trees: DataFrame, plots: DataFrame, seed: str = SEED) -> DataFrame:
    """``visit_table`` of trees that aren't joined with their plots yet.

    Trees are reduced to their visit's keys first, so the join sees one row per visit.
    """
    ticket = md5_bits(F.lit(seed), plot_key(), F.col("CN").cast("string"))
    reduced = trees.groupBy(*TREE_JOIN_KEYS).agg(F.count(F.lit(1)).alias("_n"),
                                                 F.min(ticket).alias("_ticket"))
    return (
        reduced.join(plots.select(*TREE_JOIN_KEYS, "KINDCD", "Disturbance"), TREE_JOIN_KEYS)
        .withColumn("pltID", plot_key()).groupBy(*VISIT_KEYS).agg(
            F.sum("_n").alias("N_trees"), F.bool_or(F.col("KINDCD") == 3).alias("_replaced"),
            F.bool_or(F.col("Disturbance") != "No").alias("_disturbed"),
            F.min("_ticket").alias("ticket")))


def _history():
    return Window.partitionBy("pltID").orderBy("INVYR").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)


def mark_replacements(visits: DataFrame, replacement: str = "keep") -> DataFrame:
    """``KINDCD1``: was the plot a replacement in this or an earlier year.

    ``keep`` only marks; ``drop`` removes the visits from the replacement on.
    """
    if replacement not in ("keep", "drop"):
        raise ValueError("replacement must be 'keep' or 'drop'")
    out = visits.withColumn("KINDCD1", F.bool_or("_replaced").over(_history()))
    return out.filter(~F.col("KINDCD1")) if replacement == "drop" else out


def mark_disturbance(visits: DataFrame) -> DataFrame:
    """``Description``: disturbed in this or an earlier year, and ``Disturbance`` spelled out."""
    return (
        visits.withColumn("Description", F.bool_or("_disturbed").over(_history()))
        .withColumn("Disturbance", F.when(F.col("Description"), "Yes").otherwise("No"))
    )


def sample_visits(visits: DataFrame) -> DataFrame:
    """One visit per plot, drawn with chances proportional to tree counts."""
    return (
        visits.filter(F.col("INVYR").isNotNull())
        .groupBy("pltID").agg(F.min_by("INVYR", "ticket").alias("INVYR"))
    )


def number_plots(rows: DataFrame, name: str = "Plot_Num") -> DataFrame:
    return number_distinct(rows, "pltID", name)


def chosen_visits(visits: DataFrame, min_trees: int = MIN_TREES, replacement: str = "keep",
                  number: bool = True) -> DataFrame:
    """The sampled visit of every plot with its counts, history flags and plot number."""
    kept = visits.filter(F.col("N_trees") >= min_trees)
    marked = mark_disturbance(mark_replacements(kept, replacement))
    # Same clustering as the history windows, so choosing the visit needs no further shuffle.
    drawn = F.min_by("INVYR", "ticket").over(Window.partitionBy("pltID"))
    chosen = marked.withColumn("_drawn", drawn).filter(F.col("INVYR") == F.col("_drawn")).select(
        *VISIT_KEYS, "N_trees", "KINDCD1", "Description", "Disturbance")
    if number:
        # One row per plot, written once: numbering and the join below both read it.
        chosen = materialize(chosen)
        chosen = chosen.join(number_plots(chosen), on="pltID", how="full")
    return chosen


def analysis_table(trees: DataFrame, min_trees: int = MIN_TREES, replacement: str = "keep",
                   seed: str = SEED, number: bool = True) -> DataFrame:
    """Trees of one sampled visit per plot with counts, history flags and the plot number."""
    measured = measured_trees(trees)
    chosen = chosen_visits(visit_table(measured, seed), min_trees, replacement, number)
    return measured.drop("Disturbance").join(chosen, on=VISIT_KEYS, how="inner")
