"""Analysis table -> per-plot slopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.functions.measures import inches_to_cm
from canopyframe.operators import pareto
from canopyframe.session import materialize


def _in_cm(trees: DataFrame, inches: bool) -> DataFrame:
    return trees.withColumn("DIA", inches_to_cm(F.col("DIA"))) if inches else trees


def plot_slopes(trees: DataFrame, x_min: float = pareto.X_MIN, weight: str | None = None,
                inches: bool = True, grid: int = pareto.GRID) -> DataFrame:
    """One-part fit of every plot visit."""
    sums = pareto.pareto_sums(_in_cm(trees, inches), x_min=x_min, weight=weight)
    return pareto.fit_pareto(sums, grid=grid)


def two_part_slopes(trees: DataFrame, x_min: float = pareto.X_MIN, x_max: float = pareto.X_MAX,
                    weight: str | None = None, inches: bool = True, taus: int = 40,
                    alphas: int = 40, resolve: bool = True) -> DataFrame:
    """Two-part fit of every plot visit, one row per variable.

    ``resolve=False`` keeps one grid over the whole ranges for all plots.
    """
    sums = _two_part_sums(_in_cm(trees, inches), x_min, x_max, weight, taus, alphas, resolve)
    return pareto.fit_two_part(sums, x_min=x_min, taus=taus, alphas=alphas)


def _two_part_sums(sized: DataFrame, x_min: float, x_max: float, weight: str | None, taus: int,
                   alphas: int, resolve: bool = True) -> DataFrame:
    if not resolve:
        return pareto.two_part_sums(sized, x_min=x_min, x_max=x_max, weight=weight, taus=taus)
    return pareto.resolved_sums(sized, x_min=x_min, x_max=x_max, weight=weight, taus=taus,
                                alphas=alphas)


def thinned_slopes(trees: DataFrame, x_min: float = pareto.X_MIN, x_max: float = pareto.X_MAX,
                   weight: str | None = None, inches: bool = True, two_part: bool = True,
                   grid: int = pareto.GRID, taus: int = 40, alphas: int = 40,
                   resolve: bool = True) -> DataFrame:
    """Summaries of ten thinned draw numbers per plot and variable, with slopes."""
    sized = _in_cm(trees, inches)
    wanted = pareto.thinned_iterations()
    # The sums are small next to the trees and read twice, for the draws and the tree counts.
    if two_part:
        sums = _two_part_sums(sized, x_min, x_max, weight, taus, alphas, resolve)
        sums = sums if resolve else materialize(sums)
        draws = pareto.two_part_draws(sums, iterations=wanted, x_min=x_min, taus=taus,
                                      alphas=alphas)
    else:
        sums = materialize(pareto.pareto_sums(sized, x_min=x_min, weight=weight))
        draws = pareto.pareto_draws(sums, iterations=wanted, grid=grid)
    return pareto.slope_table(pareto.draw_summaries(draws, chains=pareto.CHAINS), sums)


def full_draw_measurements(trees: DataFrame, x_min: float = pareto.X_MIN,
                           weight: str | None = None, inches: bool = True,
                           grid: int = pareto.GRID) -> DataFrame:
    """PLT_CN, corrected_slope, se_mean, sd, N_Trees: what the slope models take as measured.

    The slope is -(mean + 1) over all kept draws of the exponent; the draws are independent, so the
    standard error of their mean is sd / sqrt(draws). Plots with one draw value have no ``se_mean``.
    """
    sums = materialize(pareto.pareto_sums(_in_cm(trees, inches), x_min=x_min, weight=weight))
    return pareto.drawn_slopes(sums, grid=grid).join(sums.select("PLT_CN", "N_Trees"), "PLT_CN")
