"""Raw tables -> one row per live tree and visit -> the analysis table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.functions.keys import plot_key, text_key
from canopyframe.operators import panel, prep
from canopyframe.operators.listed import only_listed
from canopyframe.session import materialize
from canopyframe.sources.catalog import CONTIGUOUS_STATES
from canopyframe.sources.inventory import scan_table


def size_abundance(cond: DataFrame, plot: DataFrame, tree: DataFrame,
                   macro: DataFrame | None = None) -> DataFrame:
    conditions = prep.aggregate_conditions(prep.natural_stands(cond))
    plotcond = prep.plots_with_conditions(prep.annual_plots(plot), conditions)
    kept = prep.live_trees(prep.select_tree_columns(tree))
    if macro is not None:
        kept = prep.without_macroplot_trees(kept, macro)
    return prep.trees_on_plots(plotcond, kept)


def size_abundance_from_folder(spark: SparkSession, folder: str,
                               states: Sequence[str] = CONTIGUOUS_STATES,
                               macro: DataFrame | None = None) -> DataFrame:
    cond = scan_table(spark, folder, "COND", states, fill_missing=False)
    plot = scan_table(spark, folder, "PLOT", states, fill_missing=True)
    tree = scan_table(spark, folder, "TREE", states, fill_missing=False)
    return size_abundance(cond, plot, tree, macro)


def analysis_table(trees: DataFrame, **options) -> DataFrame:
    return panel.analysis_table(trees, **options)


def analysis_table_from_tables(cond: DataFrame, plot: DataFrame, tree: DataFrame,
                               macro: DataFrame | None = None, min_trees: int = panel.MIN_TREES,
                               replacement: str = "keep", seed: str = panel.SEED,
                               number: bool = True) -> DataFrame:
    """``analysis_table(size_abundance(...))`` with two lean readings of the trees.

    The first reduces trees to visits before they meet their plots; the second lets only trees of
    the sampled visits through a filter of fixed size, ahead of any shuffle, and joins them once,
    with the attributes of just those visits.
    """
    conditions = prep.aggregate_conditions(prep.natural_stands(cond))
    plots = prep.plots_with_conditions(prep.annual_plots(plot), conditions).select(
        *prep.TREE_JOIN_KEYS, "Disturbance", "STDAGE", "PLT_CN", "KINDCD", "DESIGNCD", "LON", "LAT",
        "pltID")
    live = panel.measured_trees(prep.live_trees(prep.select_tree_columns(tree)))
    counted = prep.without_macroplot_trees(live, macro) if macro is not None else live
    visits = panel.visits_of_trees(counted, plots, seed)
    chosen = panel.chosen_visits(visits, min_trees, replacement, number)
    sampled = materialize(plots.drop("Disturbance").join(chosen, panel.VISIT_KEYS).drop("pltID"))
    wanted = only_listed(live, sampled, prep.TREE_JOIN_KEYS)
    if macro is not None:
        # An anti join would be moved ahead of the filter, and shuffle all trees.
        listed = macro.select(F.col("cn").cast("string").alias("CN"), F.lit(True).alias("_listed"))
        wanted = wanted.withColumn("CN", text_key("CN")).join(listed, "CN", "left").filter(
            F.col("_listed").isNull())
    rows = wanted.select(*prep.TREE_JOIN_KEYS, "SUBP", "SPCD", "DIA", "STATUSCD", "SPGRPCD",
                         "ACTUALHT", "TPA_UNADJ", F.col("CN").alias("TRE_CN"))
    return rows.join(sampled, prep.TREE_JOIN_KEYS).withColumn("pltID", plot_key())
