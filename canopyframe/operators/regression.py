"""Simple linear regression and its fitted line from one pass of sums."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyframe.functions.student import t_quantile, two_sided_p
from canopyframe.operators.ranking import exact_quantiles


@F.pandas_udf(T.DoubleType())
def _two_sided_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else two_sided_p(a, b)
                      for a, b in zip(t, dof)], dtype="float64")


def complete_points(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
                     ).dropna()


def _centred_sums(points: DataFrame) -> DataFrame:
    return points.agg(
        F.regr_count("y", "x").alias("n"), F.regr_avgx("y", "x").alias("mean_x"),
        F.regr_avgy("y", "x").alias("mean_y"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))


def regression_sums(points: DataFrame) -> DataFrame:
    """One row: n, means, centred sums and the least-squares line of ``y`` on ``x``.

    Slope and intercept are NULL when ``x`` does not vary.
    """
    return (
        _centred_sums(points)
        .withColumn("slope", F.try_divide(F.col("sxy"), F.col("sxx")))
        .withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))
    )


def with_errors(sums: DataFrame) -> DataFrame:
    """Standard errors, t values, R squared, F and the residual standard error."""
    rss = F.when(F.col("slope").isNotNull(),
                 F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)))
    r2 = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))
    return (
        sums.withColumn("dof", F.col("n") - 2)
        .withColumn("sigma", F.sqrt(F.try_divide(rss, F.col("dof"))))
        .withColumn("r_squared", r2)
        .withColumn("adj_r_squared",
                    1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("dof")))
        .withColumn("slope_se", F.try_divide(F.col("sigma"), F.sqrt("sxx")))
        .withColumn("intercept_se", F.col("sigma") * F.sqrt(
            F.try_divide(F.lit(1), F.col("n"))
            + F.try_divide(F.col("mean_x") * F.col("mean_x"), F.col("sxx"))))
        .withColumn("slope_t", F.try_divide(F.col("slope"), F.col("slope_se")))
        .withColumn("intercept_t", F.try_divide(F.col("intercept"), F.col("intercept_se")))
        .withColumn("f_statistic", F.col("slope_t") * F.col("slope_t"))
    )


def with_p_values(summary: DataFrame) -> DataFrame:
    """Two-sided p values; the F test of one covariate has the slope's p value."""
    return (summary.withColumn("slope_p", _two_sided_p("slope_t", "dof"))
            .withColumn("intercept_p", _two_sided_p("intercept_t", "dof")))


def residual_quartiles(points: DataFrame, sums: DataFrame) -> DataFrame:
    """One row: smallest, lower quartile, median, upper quartile and largest residual."""
    line = sums.select(F.struct("intercept", "slope").alias("line")).scalar()
    residuals = points.withColumn("_line", line).select(
        (F.col("y") - F.col("_line.intercept") - F.col("_line.slope") * F.col("x"))
        .alias("residual"))
    return exact_quantiles(residuals, [], "residual", {
        "res_min": 0.0, "res_q1": 0.25, "res_median": 0.5, "res_q3": 0.75, "res_max": 1.0})


def correlation(points: DataFrame) -> DataFrame:
    """Pearson correlation, NULL when one of the variables does not vary."""
    return _centred_sums(points).select(
        F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")).alias("correlation"))


def fitted_line(points: DataFrame, steps: int = 80, level: float = 0.95) -> DataFrame:
    """The line on an even grid over the range of ``x`` with its standard error and band."""
    @F.pandas_udf(T.DoubleType())
    def half_width(dof: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(d) or d < 1 else t_quantile(0.5 + level / 2, d)
                          for d in dof], dtype="float64")

    ends = points.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    one = (
        with_errors(regression_sums(points)).withColumn("_t", half_width("dof"))
        .withColumn("_ends", ends)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    )
    x = F.col("_ends.lo") + (F.col("_ends.hi") - F.col("_ends.lo")) * F.col("_k") / (steps - 1)
    off = F.col("x") - F.col("mean_x")
    return (
        one.withColumn("x", x)
        .withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
        .withColumn("se", F.col("sigma") * F.sqrt(
            F.try_divide(F.lit(1), F.col("n")) + F.try_divide(off * off, F.col("sxx"))))
        .select("x", "fit", "se", (F.col("fit") - F.col("_t") * F.col("se")).alias("lower"),
                (F.col("fit") + F.col("_t") * F.col("se")).alias("upper"))
    )
