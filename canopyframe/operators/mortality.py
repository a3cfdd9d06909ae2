"""Mortality along a plot's history and its relation to disturbance years.

Histories are computed on one row per (plot, year); surveys of one year share their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.functions.disturbance import yes_no_flag
from canopyframe.functions.measures import event_year, years_since, zero_if_missing
from canopyframe.operators.panel import FIRST_YEAR, MIN_DIAMETER
from canopyframe.operators.ranking import first_per_key

VISIT = ["pltID", "YEAR"]


def fill_mortality(mort: DataFrame) -> DataFrame:
    return mort.withColumn("MORT_PERC", zero_if_missing(F.col("MORT_PERC")))


def running_maximum(yearly: DataFrame) -> DataFrame:
    """``Max_Mort``: the largest mortality up to and including each year of a plot."""
    so_far = Window.partitionBy("pltID").orderBy("YEAR").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return yearly.withColumn("Max_Mort", F.max("MORT_PERC").over(so_far))


def year_of_maximum(running: DataFrame) -> DataFrame:
    """``Max_Mort_Year``: the first year in which the running maximum had its current level."""
    level = Window.partitionBy("pltID", "Max_Mort").orderBy("YEAR").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return running.withColumn("Max_Mort_Year", F.min("YEAR").over(level))


def mortality_history(mort: DataFrame) -> DataFrame:
    """Every survey with running maximum, its year and the years passed since."""
    filled = fill_mortality(mort).select("pltID", "YEAR", "PLT_CN", "MORT_PERC")
    yearly = filled.groupBy(*VISIT).agg(F.max("MORT_PERC").alias("MORT_PERC"))
    history = year_of_maximum(running_maximum(yearly)).withColumn(
        "Years_Since_Max_Mort", years_since(F.col("YEAR"), F.col("Max_Mort_Year")))
    return filled.join(history.drop("MORT_PERC"), on=VISIT, how="inner")


def visit_summary(trees: DataFrame, min_diameter: float = MIN_DIAMETER,
                  first_year: int = FIRST_YEAR) -> DataFrame:
    """One row per visit (and value of its constant columns) with its count of measured trees.

    The only pass over tree rows before the final join: counts combine on the map side and the
    text columns are grouping keys, so the aggregate stays hash based.
    """
    measured = (F.col("DIA") > min_diameter) & (F.col("INVYR") >= first_year)
    return trees.groupBy("PLT_CN", "INVYR", "pltID", "Disturbance").agg(
        F.count_if(measured).alias("measured_trees"))


def visits_with_mortality(summary: DataFrame, history: DataFrame) -> DataFrame:
    """One row per visit with its mortality history; ``pltID`` is the history's."""
    first = first_per_key(summary, ["PLT_CN"], ["INVYR", "pltID", "Disturbance"])
    renamed = history.withColumnRenamed("YEAR", "INVYR")
    return (
        first.select("PLT_CN", "INVYR", "Disturbance")
        .join(renamed, on=["PLT_CN", "INVYR"], how="inner")
        .withColumn("Disturbance_Flag", yes_no_flag(F.col("Disturbance")))
    )


def single_disturbance_plots(visits: DataFrame) -> DataFrame:
    """Visits of plots disturbed in exactly one survey, with the year of that disturbance.

    ``First_Max_Mort_Year`` is ``Max_Mort_Year`` of the plot's first row.
    """
    plots = (
        visits.groupBy("pltID")
        .agg(F.sum("Disturbance_Flag").alias("_events"),
             F.count_if(F.col("Disturbance_Flag").isNull()).alias("_unknown"),
             F.max(event_year(F.col("Disturbance_Flag"), F.col("INVYR")))
             .alias("Year_of_Disturbance"),
             F.min_by("Max_Mort_Year", F.struct("INVYR", "PLT_CN")).alias("First_Max_Mort_Year"))
        .filter((F.col("_events") == 1) & (F.col("_unknown") == 0))
        .select("pltID", "Year_of_Disturbance", "First_Max_Mort_Year")
    )
    return visits.join(plots, on="pltID", how="inner").select(
        "pltID", "PLT_CN", "INVYR", "Max_Mort", "Max_Mort_Year", "Disturbance_Flag",
        "Year_of_Disturbance", "First_Max_Mort_Year")


def one_row_per_plot(single: DataFrame) -> DataFrame:
    return first_per_key(single, ["pltID"], ["INVYR", "PLT_CN"])


def matching_event_visits(single: DataFrame) -> DataFrame:
    """Disturbance-year visits of plots whose greatest mortality fell in the disturbance year."""
    return single.filter(
        (F.col("First_Max_Mort_Year") == F.col("Year_of_Disturbance"))
        & (F.col("Max_Mort_Year") == F.col("First_Max_Mort_Year"))
        & (F.col("INVYR") == F.col("Year_of_Disturbance")))


def event_trees(trees: DataFrame, events: DataFrame) -> DataFrame:
    """Trees of the event visits, with ``pltID`` from the tree side."""
    return trees.join(events.drop("pltID"), on=["INVYR", "PLT_CN"], how="inner")


def plot_mortality(tree: DataFrame, plot_id: str = "pltID") -> DataFrame:
    """Mortality percentage per plot and re-measurement year.

    Of the trees alive at the previous record, the share (by trees per acre) found dead. NULL
    where no such tree carries a weight. ``tree`` needs CN, PREV_TRE_CN, STATUSCD, TPA_UNADJ.
    """
    then = tree.filter(F.col("STATUSCD") == 1).select(
        F.col("CN").alias("PREV_TRE_CN"), F.col("TPA_UNADJ").alias("_tpa"))
    now = tree.filter(F.col("PREV_TRE_CN").isNotNull()).select(
        "PREV_TRE_CN", plot_id, F.col("INVYR").alias("YEAR"), "PLT_CN", "STATUSCD")
    died = F.when(F.col("STATUSCD") == 2, F.col("_tpa")).otherwise(0.0)
    return (
        now.join(then, on="PREV_TRE_CN", how="inner")
        .groupBy(plot_id, "YEAR", "PLT_CN")
        .agg((F.try_divide(F.sum(died), F.sum("_tpa")) * 100).alias("MORT_PERC"))
    )
