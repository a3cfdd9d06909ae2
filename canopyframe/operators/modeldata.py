"""Slopes and plot attributes -> the rows the slope models are fitted to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.functions import disturbance as dist
from canopyframe.functions.measures import error_ratio
from canopyframe.operators.ranking import first_per_key

MAX_AGE = 900


def slopes_with_attributes(slopes: DataFrame, attributes: DataFrame,
                           key: str = "PLT_CN") -> DataFrame:
    """Inner join on the plot; any other column present on both sides is rejected."""
    shared = (set(slopes.columns) & set(attributes.columns)) - {key}
    if shared:
        raise ValueError(f"columns on both sides: {', '.join(sorted(shared))}")
    return (slopes.withColumn(key, F.col(key).cast("string"))
            .join(attributes.withColumn(key, F.col(key).cast("string")), on=key, how="inner"))


def plausible_age(df: DataFrame, max_age: float = MAX_AGE) -> DataFrame:
    return df.filter((F.col("STDAGE") <= max_age) & (F.col("STDAGE") > 0))


def modelled_disturbances(df: DataFrame) -> DataFrame:
    return df.filter(F.col("DSTRBCD1").isin(list(dist.MODEL_CODES)))


def usable_slopes(df: DataFrame) -> DataFrame:
    return df.filter((F.col("STDAGE") > 0) & (F.col("MAX_HEIGHT") > 0)
                     & (F.col("corrected_slope") < 0))


def named_regions(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("ECODE_NAME", "region").filter(F.col("region") != "")


def model_rows(base: DataFrame) -> DataFrame:
    """Filters, disturbance label, region and response error of both models."""
    kept = modelled_disturbances(plausible_age(base)).withColumn(
        "Disturbance_Type", dist.disturbance_label(F.col("DSTRBCD1")))
    return named_regions(usable_slopes(kept)).withColumn(
        "error", error_ratio(F.col("se_mean"), F.col("sd")))


def without_treated_controls(rows: DataFrame, treatment: DataFrame,
                             key: str = "PLT_CN") -> DataFrame:
    """Plots with a treatment record, less the undisturbed ones that were treated.

    One filter: an undisturbed plot whose treatment is unknown is dropped as well.
    """
    treated_control = ((F.col("Disturbance_Type") == dist.BASE_LEVEL)
                       & (F.col("Treated") == "Yes"))
    named = treatment.select(F.col(key).cast("string").alias(key), "Treated")
    return rows.join(named, on=key, how="inner").filter(~treated_control)


def triggering_disturbance(rows: DataFrame, order: Sequence[str | Column] = ("PLT_CN",)
                           ) -> DataFrame:
    """``FINAL_PLT_ID`` -> ``Actual_Dist``: the tracked disturbance at time zero, first by order."""
    at_zero = (
        rows.filter(F.col("Time_Since_Dist") == 0)
        .withColumn("Actual_Dist", F.col("Disturbance_Type"))
        .filter(F.col("Actual_Dist").isin(list(dist.TRACKED_DISTURBANCES)))
    )
    return first_per_key(at_zero, ["FINAL_PLT_ID"], list(order)).select(
        "FINAL_PLT_ID", "Actual_Dist")


def follow_disturbance(rows: DataFrame, trigger: DataFrame) -> DataFrame:
    return rows.join(trigger, on="FINAL_PLT_ID", how="inner")


def with_covariates(rows: DataFrame) -> DataFrame:
    """The log10 covariates and response under the names the models use."""
    return (rows.withColumn("log_age", F.log10("STDAGE"))
            .withColumn("log_height", F.log10("MAX_HEIGHT"))
            .withColumn("y", F.col("corrected_slope")))


def design_matrix(rows: DataFrame, category: str, levels: Sequence[str], base: str,
                  covariates: Sequence[str]) -> DataFrame:
    """Intercept, covariates and one dummy per non-base level, next to the plot and response."""
    wide = dist.add_dummies(with_covariates(rows).withColumn("intercept", F.lit(1.0)), category,
                            levels, base)
    dummies = [f"is_{i + 1}" for i in range(len(dist.levels_after_base(levels, base)))]
    return wide.select("PLT_CN", "y", "error", "intercept", *covariates, *dummies)


# --- optional derivations ----------------------------------------------------------------------

def time_since_disturbance(visits: DataFrame) -> DataFrame:
    """(pltID, INVYR) -> years since the latest disturbed survey so far, NULL before the first."""
    yearly = visits.groupBy("pltID", "INVYR").agg(
        F.bool_or(F.col("Disturbance") == "Yes").alias("_disturbed"))
    so_far = Window.partitionBy("pltID").orderBy("INVYR").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("_disturbed"), F.col("INVYR")), ignorenulls=True).over(so_far)
    return yearly.select("pltID", "INVYR", (F.col("INVYR") - latest).alias("Time_Since_Dist"))


def max_height(trees: DataFrame, key: str = "PLT_CN") -> DataFrame:
    return trees.groupBy(key).agg(F.max("ACTUALHT").alias("MAX_HEIGHT"))


def treated(treatment: DataFrame, code: str = "TRTCD1", key: str = "PLT_CN") -> DataFrame:
    return treatment.select(key, dist.treated_yes_no(F.col(code).cast("int")).alias("Treated"))
