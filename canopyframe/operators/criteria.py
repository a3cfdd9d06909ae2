"""Information criteria of the one- and two-part fits, from sums per plot.

Both log densities are linear in y = ln x on either side of the break, for given parameters. So a
tree's variance of log density over the posterior needs only y and y^2 and the posterior's second
moments, and its log mean density is the logarithm of a sum over the exponents' grid alone, a smooth
function of y between two break candidates. Trees are counted in cells no wider than ``CELL`` in y
that lie between neighbouring candidates, with the sums of y and y^2; inside a cell that function is
expanded to second order around the cell's mean. What leaves the trees is a bounded table per plot,
and trees x grid never exists.

WAIC follows Watanabe (2010): elpd = sum of log mean densities - sum of variances, waic = -2 elpd;
``se`` is the standard error of elpd over a plot's trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.operators import pareto

CELL = 0.004     # widest cell in ln x: the third-order term of a cell is below 1e-9 of a tree

_RESULT = ("N_Trees long, lppd double, p_waic double, elpd double, waic double, se double")


def _cells(trees: DataFrame, plot: str, x: str, x_min: float, keys: list[Column]) -> DataFrame:
    """(plot, keys, n, s1, s2): counts and sums of y = ln(x / x_min) and y^2 per cell."""
    y = F.ln(F.col(x) / F.lit(float(x_min)))
    used = trees.filter(F.col(x) >= F.lit(float(x_min))).withColumn("_y", y)
    return used.groupBy(plot, *keys, F.floor(F.col("_y") / F.lit(CELL)).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s1"),
        F.sum(F.col("_y") * F.col("_y")).alias("s2"))


def _collected(cells: DataFrame, plot: str, bin_column: bool) -> DataFrame:
    """One row per plot; a plot's cells are bounded by the range of sizes, not by its trees."""
    own = F.col("bin") if bin_column else F.lit(0).alias("bin")
    return cells.groupBy(plot).agg(F.collect_list(F.struct(own, "n", "s1", "s2")).alias("cells"))


def _criteria(f: np.ndarray, f1: np.ndarray, f2: np.ndarray, v: np.ndarray, v1: np.ndarray,
              v2: np.ndarray, n: np.ndarray, spread: np.ndarray) -> tuple[float, ...]:
    """Sums over cells from values and derivatives at the cells' means.

    ``spread`` is a cell's sum of squared distances from its mean. ``f`` is the log mean density
    and ``v``, quadratic in y, its variance.
    """
    total = n.sum()
    lppd = float((n * f + f2 / 2 * spread).sum())
    p_waic = float((n * v + v2 / 2 * spread).sum())
    g, g1, g2 = f - v, f1 - v1, f2 - v2
    elpd = lppd - p_waic
    mean = elpd / total
    squares = float((n * (g - mean) ** 2 + (g1 ** 2 + (g - mean) * g2) * spread).sum())
    se = np.sqrt(total * max(squares, 0.0) / (total - 1)) if total > 1 else np.nan
    return int(total), lppd, p_waic, elpd, -2 * elpd, se


def _log_sums(log_c: np.ndarray, k: np.ndarray, y: np.ndarray):
    """log sum_j exp(log_c_j - k_j y) and its first two derivatives at every y."""
    terms = log_c[None, :] - k[None, :] * y[:, None]
    top = terms.max(axis=1, keepdims=True)
    w = np.exp(terms - top)
    total = w.sum(axis=1)
    mean = (w * k).sum(axis=1) / total
    var = (w * (k - mean[:, None]) ** 2).sum(axis=1) / total
    return np.log(total) + top[:, 0], -mean, var


def _moments(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Variance of a, covariance of a and b, variance of b."""
    da, db = a - (a * w).sum(), b - (b * w).sum()
    return float((w * da * da).sum()), float((w * da * db).sum()), float((w * db * db).sum())


def _cell_arrays(cells) -> tuple[np.ndarray, ...]:
    b = np.array([c["bin"] for c in cells])
    n, s1, s2 = (np.array([c[k] for c in cells], dtype=float) for k in ("n", "s1", "s2"))
    mean = s1 / n
    return b, n, mean, np.maximum(s2 - s1 * mean, 0.0)


def one_part_criteria(trees: DataFrame, plot: str = "PLT_CN", x: str = "DIA",
                      x_min: float = pareto.X_MIN, grid: int = pareto.GRID) -> DataFrame:
    """(plot, N_Trees, lppd, p_waic, elpd, waic, se) of the one-part fit."""
    kind = dict(trees.dtypes)[plot]
    sums = pareto.pareto_sums(trees, plot, x, x_min).select(plot, "N_Trees", "S")
    cells = _collected(_cells(trees, plot, x, x_min, []), plot, False)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pareto._plot_blocks(batches):
            a, w = pareto._posterior_cells(pdf["N_Trees"].to_numpy(dtype=float),
                                           pdf["S"].to_numpy(dtype=float), grid)
            rows = []
            for key, alpha, weight, own in zip(pdf[plot], a, w, pdf["cells"]):
                weight = weight / weight.sum()
                _, n, y, spread = _cell_arrays(own)
                # log density = ln a - ln x_min - (a + 1) y
                with np.errstate(divide="ignore"):
                    f, f1, f2 = _log_sums(np.log(weight) + np.log(alpha) - np.log(x_min),
                                          alpha + 1, y)
                aa, ab, bb = _moments(np.log(alpha), -(alpha + 1), weight)
                v = aa + 2 * ab * y + bb * y * y
                rows.append((key, *_criteria(f, f1, f2, v, 2 * ab + 2 * bb * y,
                                             np.full(len(y), 2 * bb), n, spread)))
            yield pd.DataFrame(rows, columns=[plot, *_names()])

    return pareto._spread(sums.join(cells, plot), plot).mapInPandas(judge, f"{plot} {kind}, {_RESULT}")


def _names() -> list[str]:
    return [c.strip().split(" ")[0] for c in _RESULT.split(",")]


def two_part_criteria(trees: DataFrame, sums: DataFrame, plot: str = "PLT_CN", x: str = "DIA",
                      x_min: float = pareto.X_MIN, taus: int = 40, alphas: int = 40) -> DataFrame:
    """The same of the two-part fit; ``sums`` come from ``pareto.resolved_sums`` (or
    ``two_part_sums``) of the same trees and grid."""
    kind = dict(trees.dtypes)[plot]
    # Cells don't cross a plot's own break candidates.
    ranged = trees.join(sums.select(plot, F.col("tau_low").alias("_lo"),
                                    F.col("tau_high").alias("_hi")), plot)
    place = F.floor((F.col(x) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / F.lit(taus)) + 0.5)
    bins = F.least(F.greatest(place, F.lit(0)), F.lit(taus)).cast("int").alias("bin")
    cells = _collected(_cells(ranged, plot, x, x_min, [bins]), plot, True)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids = pareto._Grids(x_min, taus, alphas)
        for pdf in batches:
            rows = []
            for (key, _, _, grid, post), own in zip(pareto._posteriors(pdf, plot, grids),
                                                    pdf["cells"]):
                rows.append((key, *_two_part(grid, post, x_min, own)))
            yield pd.DataFrame(rows, columns=[plot, *_names()])

    return pareto._spread(sums.join(cells, plot), plot).select(
        *pareto._sum_columns(plot), "cells").mapInPandas(judge, f"{plot} {kind}, {_RESULT}")


def _two_part(grid, post: np.ndarray, x_min: float, cells) -> tuple[float, ...]:
    lo, hi = grid.low[None, :, None], grid.high[None, None, :]
    tau = grid.tau[:, None, None]
    base = np.log(x_min)
    # Log density in y = ln(x / x_min): below the break and from it on.
    below = grid.log_norm + grid.join - (lo + 1) * base
    above = grid.log_norm - (hi + 1) * base
    with np.errstate(divide="ignore"):
        log_post = np.log(post)
    # What every number of candidates below a size needs, once per candidate and side.
    under, over = _by_break(post, below, -(lo + 1)), _by_break(post, above, -(hi + 1))
    mass = post.sum(axis=(1, 2))
    log_below, log_above = _logsumexp(log_post + below, (2,)), _logsumexp(log_post + above, (1,))
    b, n, y, spread = _cell_arrays(cells)
    out = [np.zeros(len(b)) for _ in range(6)]
    for own in np.unique(b):
        at = np.flatnonzero(b == own)
        # From ``own`` candidates on the size lies above the break.
        passed = np.arange(len(grid.tau)) < own
        aa, ab, bb = _pooled(mass, *np.where(passed, over, under))
        # One term per exponent of either side, whatever the number of candidates.
        log_c = [_logsumexp(np.where(passed[:, None], -np.inf, log_below), (0,)),
                 _logsumexp(np.where(passed[:, None], log_above, -np.inf), (0,))]
        f, f1, f2 = _log_sums(np.concatenate(log_c), np.concatenate([grid.low, grid.high]) + 1,
                              y[at])
        for k, values in enumerate((f, f1, f2, aa + 2 * ab * y[at] + bb * y[at] ** 2,
                                    2 * ab + 2 * bb * y[at], np.full(len(at), 2 * bb))):
            out[k][at] = values
    return _criteria(*out, n, spread)


def _by_break(post: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per break candidate: means of a and b, and sums of their squares and product around these."""
    mass = post.sum(axis=(1, 2))
    whole = np.where(mass > 0, mass, 1.0)
    mean_a, mean_b = (post * a).sum(axis=(1, 2)) / whole, (post * b).sum(axis=(1, 2)) / whole
    da, db = a - mean_a[:, None, None], b - mean_b[:, None, None]
    wa = post * da
    return np.stack([mean_a, mean_b, (wa * da).sum(axis=(1, 2)), (wa * db).sum(axis=(1, 2)),
                     (post * db * db).sum(axis=(1, 2))])


def _pooled(mass: np.ndarray, mean_a: np.ndarray, mean_b: np.ndarray, aa: np.ndarray, ab: np.ndarray,
            bb: np.ndarray) -> tuple[float, float, float]:
    """Variance of a, covariance of a and b, variance of b over all break candidates."""
    da, db = mean_a - mass @ mean_a, mean_b - mass @ mean_b
    return (float(aa.sum() + mass @ (da * da)), float(ab.sum() + mass @ (da * db)),
            float(bb.sum() + mass @ (db * db)))


def _logsumexp(values: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    top = values.max(axis=axes, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - safe).sum(axis=axes)) + safe.squeeze(axes)


def compared(one: DataFrame, two: DataFrame, plot: str = "PLT_CN") -> DataFrame:
    """Per plot: elpd of both fits, their difference (two-part minus one-part) and the better one."""
    a = one.select(plot, "N_Trees", F.col("elpd").alias("elpd_one"), F.col("waic").alias("waic_one"))
    b = two.select(plot, F.col("elpd").alias("elpd_two"), F.col("waic").alias("waic_two"))
    return a.join(b, plot).withColumn("elpd_gain", F.col("elpd_two") - F.col("elpd_one")).withColumn(
        "better", F.when(F.col("elpd_gain") > 0, "two_part").otherwise("one_part"))
