"""From raw conditions, plots and trees to one row per live tree and plot visit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.functions.disturbance import disturbance_sum, disturbed_yes_no
from canopyframe.functions.keys import plot_key, text_key

VISIT_KEYS = ["pltID", "INVYR"]
TREE_JOIN_KEYS = ["INVYR", "STATECD", "UNITCD", "COUNTYCD", "PLOT"]


def natural_stands(cond: DataFrame) -> DataFrame:
    return cond.filter(F.col("STDORGCD") == 0)


def with_known_age(cond: DataFrame) -> DataFrame:
    return cond.dropna(subset=["STDAGE"])


def stacked(parts: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    """Rows of all parts by column name; a column that a part lacks is NULL there if allowed."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=fill_missing)
    return out


def annual_plots(plot: DataFrame) -> DataFrame:
    """Without periodic (0) and modelled periodic (4) plots; unknown kinds go too."""
    return plot.filter(~F.col("KINDCD").isin(0, 4))


def live_trees(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("STATUSCD") == 1)


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of the non-null values; NULL as soon as one of their weights is NULL or all are 0."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    lost = F.count_if(F.col(value).isNotNull() & F.col(weight).isNull())
    mean = F.try_divide(F.sum(F.col(value) * w), F.sum(w))
    return F.when(lost == 0, mean)


def code_sum(name: str) -> Column:
    """Sum that skips NULL and is 0, not NULL, for a group without values."""
    return F.coalesce(F.sum(name), F.lit(0))


def aggregate_conditions(cond: DataFrame) -> DataFrame:
    """One row per plot visit: area-weighted stand age, code sums and the disturbed flag."""
    codes = ["DSTRBCD1", "DSTRBCD2", "DSTRBCD3"]
    return (
        with_known_age(cond.withColumn("pltID", plot_key()))
        .groupBy(*VISIT_KEYS)
        .agg(weighted_mean("STDAGE", "CONDPROP_UNADJ").alias("STDAGE"),
             *[code_sum(c).alias(c) for c in codes])
        .withColumn("DisturbSum", disturbance_sum(*codes))
        .withColumn("Disturbance", disturbed_yes_no(F.col("DisturbSum")))
    )


def plots_with_conditions(plot: DataFrame, conditions: DataFrame) -> DataFrame:
    named = plot.withColumn("pltID", plot_key()).withColumnRenamed("CN", "PLT_CN")
    return named.join(conditions, on=["INVYR", "pltID"], how="inner")


def without_macroplot_trees(tree: DataFrame, macro: DataFrame) -> DataFrame:
    """Trees whose record key is not on the macroplot list.

    Keys are compared as text. The list grows with the inventory, so it is left to the optimizer
    to broadcast it only when its measured size allows.
    """
    listed = macro.select(F.col("cn").cast("string").alias("CN"))
    return tree.withColumn("CN", text_key("CN")).join(listed, on="CN", how="left_anti")


def select_tree_columns(tree: DataFrame) -> DataFrame:
    return tree.select("INVYR", "CN", "PREV_TRE_CN", "PLT_CN", "STATUSCD", "ACTUALHT", "STATECD",
                       "UNITCD", "COUNTYCD", "PLOT", "SUBP", "SPCD", "DIA", "SPGRPCD",
                       "TPA_UNADJ")


def trees_on_plots(plotcond: DataFrame, tree: DataFrame) -> DataFrame:
    """Live trees with their visit's attributes.

    ``PLT_CN`` is the plot side's. The tree's record key is kept as ``TRE_CN``.
    """
    plots = plotcond.select(*TREE_JOIN_KEYS, "Disturbance", "STDAGE", "PLT_CN", "KINDCD",
                            "DESIGNCD", "LON", "LAT")
    trees = tree.select(*TREE_JOIN_KEYS, "SUBP", "SPCD", "DIA", "STATUSCD", "SPGRPCD",
                        "ACTUALHT", "TPA_UNADJ", F.col("CN").alias("TRE_CN"))
    return trees.join(plots, on=TREE_JOIN_KEYS, how="inner").withColumn("pltID", plot_key())
