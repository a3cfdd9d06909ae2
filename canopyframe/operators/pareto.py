"""Per-plot Pareto fits, draws, pointwise likelihood and slopes.

The posterior of either fit depends on a plot's trees only through a few sums, so the trees are
reduced by a map-side-combined aggregate and never travel to a single task, and the posterior is
evaluated on a bounded grid per plot.

One-part fit: x ~ Pareto(x_min, alpha), alpha in (0, 5), lognormal(1, 1) prior.
Two-part fit: exponent alpha_low in (0, 5) below the break tau, alpha_high in (0, 10) above it,
both lognormal(1, 1), tau uniform on (x_min, x_max).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.functions.measures import slope_from_exponent
from canopyframe.functions.twopart import two_part_log_density
from canopyframe.operators.ranking import summarise_groups
from canopyframe.session import materialize

X_MIN = 12.7
X_MAX = 50.0
ALPHA_MAX = 5.0
ALPHA_HIGH_MAX = 10.0
GRID = 500
# The grid spans 12 standard deviations around the likelihood's peak, and 40 / n of the peak more
# above it, where the likelihood of a few trees falls off as exp(-alpha * S) only. Beyond that the
# posterior has no mass worth a digit, whatever the number of trees.
GRID_HALF_WIDTH = 12.0
GRID_TAIL = 40.0

# Two-part fit: an axis is resolved once the standard deviation spans so many steps and neither end
# that could be moved holds more than EDGE_MASS.
RESOLVED_STEPS, EDGE_MASS = 1.5, 1e-3
LEAST_CELLS = 24            # cells that fit both ends and RESOLVED_STEPS
NARROWINGS, PASSES = 60, 30   # looks at the exponents and passes over the trees; more than that raise

CHAINS = 4
KEPT_ITERATIONS = 3000


def thinned_iterations(first: int = 100, last: int = KEPT_ITERATIONS, count: int = 10) -> list[int]:
    """Evenly spaced iteration numbers, rounded (100, 422, 744, ..., 3000 by default)."""
    step = (last - first) / (count - 1)
    return [int(round(first + i * step)) for i in range(count)]


def tree_counts(trees: DataFrame, plot: str = "PLT_CN", x: str = "DIA", x_min: float = X_MIN,
                weight: str | None = None) -> DataFrame:
    """Per plot, fitted or not: N_rows, N_missing (no size or weight), N_below, N_Trees, fitted.

    The fits take ``N_Trees`` rows; a plot of which none is left has no fit.
    """
    known = F.col(x).isNotNull()
    if weight is not None:
        known = known & F.col(weight).isNotNull()
    below = F.col(x) < F.lit(float(x_min))
    return trees.groupBy(plot).agg(
        F.count(F.lit(1)).alias("N_rows"), F.count_if(~known).alias("N_missing"),
        F.count_if(known & below).alias("N_below"), F.count_if(known & ~below).alias("N_Trees")
    ).withColumn("fitted", F.col("N_Trees") > 0)


# --- one-part fit ------------------------------------------------------------------------------

def pareto_sums(trees: DataFrame, plot: str = "PLT_CN", x: str = "DIA", x_min: float = X_MIN,
                weight: str | None = None) -> DataFrame:
    """Per plot: tree count, sum of ln(x / x_min), and how many rows lay below ``x_min``.

    With ``weight`` the log sizes are weighted and the weights rescaled to sum to the count.
    """
    used = F.col(x) >= F.lit(float(x_min))
    log_size = F.when(used, F.ln(F.col(x) / F.lit(float(x_min))))
    if weight is None:
        total = F.sum(log_size)
    else:
        w = F.when(used, F.col(weight).cast("double"))
        total = F.try_divide(F.sum(w * log_size), F.sum(w)) * F.count_if(used & w.isNotNull())
        used = used & w.isNotNull()
    return (
        trees.dropna(subset=[x]).groupBy(plot)
        .agg(F.count_if(used).alias("N_Trees"), total.alias("S"),
             F.count_if(F.col(x) < F.lit(float(x_min))).alias("N_below"))
        .filter((F.col("N_Trees") > 0) & F.col("S").isNotNull())
    )


def _grid_edges(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        peak = np.minimum(n / s, ALPHA_MAX)
    reach = GRID_HALF_WIDTH * peak / np.sqrt(n)
    return (np.maximum(peak - reach, 0.0),
            np.minimum(peak + reach + GRID_TAIL * peak / n, ALPHA_MAX))


def _posterior_cells(n: np.ndarray, s: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid midpoints and unnormalised weights, one row per plot.

    Log weights are shifted by their maximum before exponentiation.
    """
    low, high = _grid_edges(n, s)
    a = low[:, None] + ((high - low) / grid)[:, None] * (np.arange(1, grid + 1) - 0.5)
    log_a = np.log(a)
    weight = (n - 1)[:, None] * log_a - a * s[:, None] - (log_a - 1) ** 2 / 2
    return a, np.exp(weight - weight.max(axis=1, keepdims=True))


_PLOTS_PER_BLOCK = 2000


def _plot_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for start in range(0, len(pdf), _PLOTS_PER_BLOCK):
            yield pdf.iloc[start:start + _PLOTS_PER_BLOCK]


def _spread(sums: DataFrame, plot: str) -> DataFrame:
    """Sums are a few bytes per plot, but each means a grid or thousands of draws, so their
    partitions must not be merged by size."""
    return sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), plot)


def fit_pareto(sums: DataFrame, plot: str = "PLT_CN", grid: int = GRID) -> DataFrame:
    """Posterior summary of the exponent per plot, from ``pareto_sums``.

    One row in, one row out: the grid of a block of plots is a matrix inside the task. Measured
    against the same grid in array expressions, the matrix form took a hundredth of the time.
    """
    kind = dict(sums.dtypes)[plot]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _plot_blocks(batches):
            n = pdf["N_Trees"].to_numpy(dtype=float)
            s = pdf["S"].to_numpy(dtype=float)
            a, w = _posterior_cells(n, s, grid)
            total = w.sum(axis=1)
            mean = (a * w).sum(axis=1) / total
            var = (w * (a - mean[:, None]) ** 2).sum(axis=1) / total
            cum = np.cumsum(w, axis=1)
            rows = np.arange(len(pdf))

            def quantile(prob: float) -> np.ndarray:
                below = (cum < prob * cum[:, -1:]).sum(axis=1)
                return a[rows, np.minimum(below, grid - 1)]

            yield pd.DataFrame({
                plot: pdf[plot].to_numpy(), "N_Trees": pdf["N_Trees"].to_numpy(),
                "N_below": pdf["N_below"].to_numpy(), "S": s,
                "alpha_mean": mean, "alpha_sd": np.sqrt(var), "q5": quantile(0.05),
                "median": quantile(0.5), "q95": quantile(0.95)})

    fitted = _spread(sums, plot).select(plot, "N_Trees", "N_below", "S").mapInPandas(
        fit, f"{plot} {kind}, N_Trees long, N_below long, S double, alpha_mean double, "
             "alpha_sd double, q5 double, median double, q95 double")
    return (fitted.withColumn("alpha_mle", F.try_divide(F.col("N_Trees"), F.col("S")))
            .withColumn("corrected_slope",
                        slope_from_exponent(F.lit("alpha"), F.col("alpha_mean"))))


# --- two-part fit ------------------------------------------------------------------------------

def _binned_sums(trees: DataFrame, plot: str, x: str, x_min: float, weight: str | None, taus: int,
                 low: Column, high: Column) -> DataFrame:
    """Per plot: counts and log-size sums between neighbouring break candidates.

    The candidates are the ``taus`` cell midpoints of (low, high), which may differ by plot. Bin
    ``b`` holds the sizes that lie at or above exactly ``b`` of them, so a plot of any size becomes
    at most ``taus + 1`` bins; bin -1 counts the rows below ``x_min``.
    """
    place = F.floor((F.col(x) - low) / ((high - low) / F.lit(taus)) + 0.5)
    inside = F.least(F.greatest(place, F.lit(0)), F.lit(taus)).cast("int")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    cells = trees.filter(F.col(x).isNotNull() & w.isNotNull()).groupBy(
        plot, F.when(F.col(x) < F.lit(float(x_min)), -1).otherwise(inside).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * F.ln(x)).alias("s"))
    # The grid work per plot is large next to its few bytes, so the partition count is fixed here
    # instead of being merged by size; the grouping below reuses this distribution.
    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = F.col("bin") >= 0
    return cells.repartition(parts, plot).groupBy(plot).agg(
        F.coalesce(F.sum(F.when(used, F.col("n"))), F.lit(0)).alias("N_Trees"),
        F.sum(F.when(used, F.col("w"))).alias("W"),
        F.coalesce(F.sum(F.when(~used, F.col("n"))), F.lit(0)).alias("N_below"),
        F.collect_list(F.when(used, F.struct("bin", "w", "s"))).alias("bins")
    ).filter("N_Trees > 0")


def two_part_sums(trees: DataFrame, plot: str = "PLT_CN", x: str = "DIA", x_min: float = X_MIN,
                  x_max: float = X_MAX, weight: str | None = None, taus: int = 40) -> DataFrame:
    """Sums of every plot at fixed break candidates and whole ranges of the exponents."""
    low, high = F.lit(float(x_min)), F.lit(float(x_max))
    return _binned_sums(trees, plot, x, x_min, weight, taus, low, high).withColumns({
        "tau_low": low, "tau_high": high,
        "ranges": F.array(*[F.lit(v) for v in (0.0, ALPHA_MAX, 0.0, ALPHA_HIGH_MAX)])})


def resolved_sums(trees: DataFrame, plot: str = "PLT_CN", x: str = "DIA", x_min: float = X_MIN,
                  x_max: float = X_MAX, weight: str | None = None, taus: int = 40,
                  alphas: int = 40) -> DataFrame:
    """``two_part_sums`` over ranges that resolve every plot's posterior on all three axes.

    The exponents' ranges are narrowed from the sums alone. Where the break's posterior is narrower
    than its candidates lie apart, as in plots with very many trees, the trees of those plots are
    binned again between closer candidates of their own, until the standard deviation spans
    ``RESOLVED_STEPS`` steps and neither end of the range holds mass. Only the trees of such plots
    are read again, from a written copy; the ranges are one row per plot. A plot that is not
    resolved within ``PASSES`` passes raises.
    """
    if min(taus, alphas) < LEAST_CELLS:
        raise ValueError(f"a posterior can be resolved on {LEAST_CELLS} cells or more per axis")
    kind = dict(trees.dtypes)[plot]
    columns = [plot, "N_Trees", "W", "N_below", "bins", "tau_low", "tau_high"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids = _Grids(x_min, taus, alphas)
        for pdf in batches:
            ranges, nexts, settled = [], [], []
            for key, n, w, bins, low, high in zip(pdf[plot], pdf["N_Trees"], pdf["W"], pdf["bins"],
                                                  pdf["tau_low"], pdf["tau_high"]):
                grid, post = _resolved_exponents(key, grids, (low, high), n, n / w, bins)
                wanted, done = _next_range(grid.tau, post.sum(axis=(1, 2)), x_min, x_max)
                ranges.append([*grid.low_range, *grid.high_range])
                nexts.append(list(wanted))
                settled.append(done)
            yield pdf.assign(ranges=ranges, next=nexts, settled=settled)

    def judged(sums: DataFrame) -> DataFrame:
        cell = "struct<bin: int, w: double, s: double>"
        return materialize(sums.select(columns).mapInPandas(
            judge, f"{plot} {kind}, N_Trees long, W double, N_below long, bins array<{cell}>, "
                   "tau_low double, tau_high double, ranges array<double>, next array<double>, "
                   "settled boolean"))

    state = judged(two_part_sums(trees, plot, x, x_min, x_max, weight, taus))
    found, wanted = [], [plot, x] + ([weight] if weight else [])
    rows = trees.select(wanted).filter(F.col(x) >= F.lit(float(x_min)))
    for turn in range(PASSES):
        found.append(state.filter("settled").select(*columns, "ranges"))
        open_ranges = state.filter(~F.col("settled")).select(
            plot, F.col("next")[0].alias("tau_low"), F.col("next")[1].alias("tau_high"),
            F.col("N_below").alias("_below"))
        if open_ranges.isEmpty():
            break
        if turn == 0:
            # All later passes read only these plots' rows.
            rows = materialize(rows.join(open_ranges.select(plot), plot, "left_semi"))
        # A hot plot's rows stay where they are or are split by adaptive execution: the ranges
        # have one row per plot.
        ranged = rows.join(open_ranges, plot)
        sums = _binned_sums(ranged, plot, x, x_min, weight, taus, F.col("tau_low"),
                            F.col("tau_high")).drop("N_below")
        state = judged(sums.join(open_ranges.withColumnRenamed("_below", "N_below"), plot))
    else:
        raise RuntimeError(f"breaks were not resolved within {PASSES} passes")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _spread(out, plot)


class _TwoPartGrid:
    """A (tau, alpha_low, alpha_high) grid and the plot-independent terms on it."""

    def __init__(self, x_min: float, tau: tuple[float, float], taus: int, alphas: int,
                 low: tuple[float, float] = (0.0, ALPHA_MAX),
                 high: tuple[float, float] = (0.0, ALPHA_HIGH_MAX)):
        self.low_range, self.high_range = tuple(low), tuple(high)
        half = (np.arange(1, alphas + 1) - 0.5) / alphas
        self.tau = tau[0] + (tau[1] - tau[0]) * (np.arange(1, taus + 1) - 0.5) / taus
        self.low = low[0] + (low[1] - low[0]) * half
        self.high = high[0] + (high[1] - high[0]) * half
        t = self.tau[:, None, None]
        lo = self.low[None, :, None]
        hi = self.high[None, None, :]
        # Scaled by tau: (tau/x_min)^lo keeps the powers near one.
        mass = (np.power(t / x_min, lo) - 1.0) / lo + 1.0 / hi
        self.log_norm = hi * np.log(t) - np.log(mass)
        self.join = (lo - hi) * np.log(t)
        self.prior = (-np.log(lo) - (np.log(lo) - 1.0) ** 2 / 2
                      - np.log(hi) - (np.log(hi) - 1.0) ** 2 / 2)
        self.lo1 = lo + 1.0
        self.hi1 = hi + 1.0

    def weights(self, n: float, scale: float, bins: Sequence) -> np.ndarray:
        """Posterior weights summing to one; ``scale`` turns weighted sums into counts."""
        taus = len(self.tau)
        count = np.zeros(taus + 1)
        logs = np.zeros(taus + 1)
        for cell in bins:
            count[cell["bin"]] += cell["w"] * scale
            logs[cell["bin"]] += cell["s"] * scale
        n_low = np.cumsum(count)[:taus, None, None]
        s_low = np.cumsum(logs)[:taus, None, None]
        post = (n * self.log_norm + n_low * self.join - self.lo1 * s_low
                - self.hi1 * (logs.sum() - s_low) + self.prior)
        post = np.exp(post - post.max())
        return post / post.sum()


class _Grids:
    """Grids by their ranges: most plots share the whole ranges, whose powers are then made once."""

    def __init__(self, x_min: float, taus: int, alphas: int):
        self.shape = (x_min, taus, alphas)
        self.whole: dict[tuple, _TwoPartGrid] = {}

    def get(self, tau: tuple[float, float], ranges: Sequence[float]) -> _TwoPartGrid:
        x_min, taus, alphas = self.shape
        low, high = tuple(ranges[:2]), tuple(ranges[2:])
        if (low, high) != ((0.0, ALPHA_MAX), (0.0, ALPHA_HIGH_MAX)):
            return _TwoPartGrid(x_min, tau, taus, alphas, low, high)
        if tau not in self.whole:
            self.whole = {tau: _TwoPartGrid(x_min, tau, taus, alphas)}
        return self.whole[tau]


def _resolved_exponents(key: object, grids: _Grids, tau: tuple[float, float], n: float,
                        scale: float, bins: Sequence):
    """(grid, weights) whose exponents' cells resolve the mass."""
    low, high = (0.0, ALPHA_MAX), (0.0, ALPHA_HIGH_MAX)
    for _ in range(NARROWINGS):
        grid = grids.get(tau, (*low, *high))
        post = grid.weights(n, scale, bins)
        low, low_done = _next_range(grid.low, post.sum(axis=(0, 2)), 0.0, ALPHA_MAX)
        high, high_done = _next_range(grid.high, post.sum(axis=(0, 1)), 0.0, ALPHA_HIGH_MAX)
        if low_done and high_done:
            return grid, post
    raise RuntimeError(f"exponents of plot {key} were not resolved")


def _next_range(cells: np.ndarray, weights: np.ndarray, bottom: float,
                top: float) -> tuple[tuple[float, float], bool]:
    """The range to look at next, and whether the present one resolves the mass."""
    step = cells[1] - cells[0]
    low, high = cells[0] - step / 2, cells[-1] + step / 2
    mean = float(cells @ weights)
    sd = math.sqrt(max(float(((cells - mean) ** 2) @ weights), 0.0))
    cut = ((weights[0] > EDGE_MASS and low > bottom + 1e-9 * (top - bottom))
           or (weights[-1] > EDGE_MASS and high < top - 1e-9 * (top - bottom)))
    if cut:
        reach = high - low
    elif sd < RESOLVED_STEPS * step:
        # As wide as still resolves the mass: then the next look is the last one if ``sd`` is right.
        reach = max(len(cells) * sd / (2.2 * RESOLVED_STEPS), 2 * step)
    else:
        return (low, high), True
    return (max(mean - reach, bottom), min(mean + reach, top)), False


def _marginal_stats(values: np.ndarray, weights: np.ndarray) -> tuple[float, ...]:
    mean = float(values @ weights)
    sd = math.sqrt(max(float(((values - mean) ** 2) @ weights), 0.0))
    cum = np.cumsum(weights)
    q5, median, q95 = (float(values[min(np.searchsorted(cum, p * cum[-1]), len(values) - 1)])
                       for p in (0.05, 0.5, 0.95))
    return mean, sd, q5, median, q95, float(weights[0] + weights[-1])


def fit_two_part(sums: DataFrame, plot: str = "PLT_CN", x_min: float = X_MIN, taus: int = 40,
                 alphas: int = 40) -> DataFrame:
    """Posterior summary of alpha_low, alpha_high and tau per plot, one row per variable.

    ``sums`` come from ``resolved_sums`` or, on the whole ranges, ``two_part_sums`` with the same
    ``taus``. ``edge_mass`` is the marginal posterior mass in the first and last grid cell: a value
    near one says that the data do not identify the variable inside its range.
    """
    kind = dict(sums.dtypes)[plot]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids = _Grids(x_min, taus, alphas)
        for pdf in batches:
            rows = []
            for key, n, below, grid, post in _posteriors(pdf, plot, grids):
                for name, values, axes in (("alpha_low", grid.low, (0, 2)),
                                           ("alpha_high", grid.high, (0, 1)),
                                           ("tau", grid.tau, (1, 2))):
                    rows.append((key, name, n, below,
                                 *_marginal_stats(values, post.sum(axis=axes))))
            yield pd.DataFrame(rows, columns=[plot, "variable", "N_Trees", "N_below", "mean", "sd",
                                              "q5", "median", "q95", "edge_mass"])

    fitted = sums.select(*_sum_columns(plot)).mapInPandas(
        fit, f"{plot} {kind}, variable string, N_Trees long, N_below long, mean double, sd double, "
             "q5 double, median double, q95 double, edge_mass double")
    return fitted.withColumn("corrected_slope",
                             slope_from_exponent(F.col("variable"), F.col("mean")))


def _sum_columns(plot: str) -> list[str]:
    return [plot, "N_Trees", "W", "N_below", "bins", "tau_low", "tau_high", "ranges"]


def _posteriors(pdf: pd.DataFrame, plot: str, grids: _Grids):
    """(key, N_Trees, N_below, grid, weights) of every plot."""
    for key, n, w, below, bins, low, high, ranges in zip(
            *(pdf[c] for c in _sum_columns(plot))):
        grid = grids.get((low, high), ranges)
        yield key, n, below, grid, grid.weights(n, n / w, bins)


def two_part_parameters(fitted: DataFrame, plot: str = "PLT_CN") -> DataFrame:
    """Posterior means side by side: plot, alpha_low, alpha_high, tau."""
    return fitted.groupBy(plot).agg(*[
        F.max(F.when(F.col("variable") == v, F.col("mean"))).alias(v)
        for v in ("alpha_low", "alpha_high", "tau")])


def pointwise_log_likelihood(trees: DataFrame, parameters: DataFrame, plot: str = "PLT_CN",
                             x: str = "DIA", x_min: float = X_MIN) -> DataFrame:
    """``log_lik`` of every tree under its plot's two-part parameters."""
    used = trees.filter(F.col(x) >= F.lit(float(x_min)))
    return used.join(parameters, on=plot, how="inner").withColumn(
        "log_lik", two_part_log_density(F.col(x), F.col("alpha_low"), F.col("alpha_high"),
                                        F.col("tau"), F.lit(float(x_min))))


# --- draws -------------------------------------------------------------------------------------

def _uniforms(plot: str, seed: str, iterations: Sequence[int] | None) -> Column:
    """One uniform number per (chain, iteration) of a plot: 52 bits of an md5, made by the JVM.

    Each depends on its own plot, chain and iteration only, so some iterations get the numbers that
    a full table holds for them.
    """
    wanted = (F.sequence(F.lit(1), F.lit(KEPT_ITERATIONS)) if iterations is None
              else F.array(*[F.lit(int(i)) for i in iterations]))
    key = F.concat_ws("|", F.lit(seed), F.col(plot).cast("string"))

    def of(chain: Column) -> Column:
        return F.transform(wanted, lambda i: F.conv(F.substring(F.md5(F.concat_ws(
            "|", key, chain.cast("string"), i.cast("string")).cast("binary")), 1, 13), 16, 10)
            .cast("double") / F.lit(float(1 << 52)))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(CHAINS)), of))


def _draw_rows(drawn: DataFrame, plot: str, variables: Sequence[str],
               iterations: Sequence[int] | None) -> DataFrame:
    """Long rows from one array of values per plot and variable."""
    each = KEPT_ITERATIONS if iterations is None else len(iterations)
    at = F.col("_at")
    iteration = at % each + 1 if iterations is None else F.element_at(
        F.array(*[F.lit(int(i)) for i in iterations]), (at % each + 1).cast("int"))
    long = drawn.select(plot, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).alias("values")) for v in variables])).alias(
            "_v")).select(plot, "_v.variable", F.posexplode("_v.values").alias("_at", "value"))
    return long.select(plot, "variable", (F.floor(at / each) + 1).cast("int").alias("chain"),
                       iteration.cast("int").alias("iteration"), "value")


def _picked(cum: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Cells of some uniform numbers by inverting the cumulative weights."""
    return np.minimum(np.searchsorted(cum, u * cum[-1]), len(cum) - 1)


def _named_uniforms(key: str, names: list[bytes]) -> np.ndarray:
    """The numbers of ``_uniforms`` inside a task: 52 bits of the md5 of the key and every name."""
    start = hashlib.md5(key.encode(), usedforsecurity=False)

    def digest(name: bytes) -> bytes:
        one = start.copy()
        one.update(name)
        return one.digest()

    bits = np.frombuffer(b"".join(map(digest, names)), ">u8")[::2].astype(np.uint64) >> np.uint64(12)
    return bits.astype(float) / float(1 << 52)


def _cell_counts(cum: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of the uniform numbers pick each cell, as ``_picked`` does."""
    ends = np.searchsorted(np.sort(u * cum[-1]), cum, "right")
    ends[-1] = len(u)
    return np.diff(ends, prepend=0)


_DRAWS_PER_FRAME = 1_000_000


def _frames(rows: Iterator[tuple], names: list[str], each: int) -> Iterator[pd.DataFrame]:
    """Frames of a bounded number of draws."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) * each * (len(names) - 1) >= _DRAWS_PER_FRAME:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _in_small_batches(sums: DataFrame, plot: str, columns: list[str], seed: str,
                      iterations: Sequence[int] | None) -> DataFrame:
    """Sums with their uniform numbers, dealt over all tasks."""
    return _spread(sums, plot).select(*columns, _uniforms(plot, seed, iterations).alias("_u"))


def pareto_draws(sums: DataFrame, plot: str = "PLT_CN", iterations: Sequence[int] | None = None,
                 seed: str = "draws", grid: int = GRID) -> DataFrame:
    """Independent posterior draws of ``alpha``: long rows (plot, variable, chain, iteration, value).

    Draws are independent, so asking for some ``iterations`` yields exactly the rows a full table
    would hold for them.
    """
    kind = dict(sums.dtypes)[plot]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def per_plot():
            for pdf in _plot_blocks(batches):
                a, w = _posterior_cells(pdf["N_Trees"].to_numpy(dtype=float),
                                        pdf["S"].to_numpy(dtype=float), grid)
                cum = np.cumsum(w, axis=1)
                for i, (key, u) in enumerate(zip(pdf[plot], pdf["_u"])):
                    yield key, a[i][_picked(cum[i], u)]

        yield from _frames(per_plot(), [plot, "alpha"], _draw_count(iterations))

    drawn = _in_small_batches(sums, plot, [plot, "N_Trees", "S"], seed, iterations).mapInPandas(
        draw, f"{plot} {kind}, alpha array<double>")
    return _draw_rows(drawn, plot, ["alpha"], iterations)


def _draw_count(iterations: Sequence[int] | None) -> int:
    return CHAINS * (KEPT_ITERATIONS if iterations is None else len(iterations))


def two_part_draws(sums: DataFrame, plot: str = "PLT_CN",
                   iterations: Sequence[int] | None = None, seed: str = "draws",
                   x_min: float = X_MIN, taus: int = 40, alphas: int = 40) -> DataFrame:
    """Joint posterior draws of alpha_low, alpha_high and tau in the same long layout."""
    kind = dict(sums.dtypes)[plot]
    names = ["alpha_low", "alpha_high", "tau"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids = _Grids(x_min, taus, alphas)

        def per_plot():
            for pdf in batches:
                for (key, _, _, grid, post), u in zip(_posteriors(pdf, plot, grids), pdf["_u"]):
                    index = _picked(np.cumsum(post.ravel()), u)
                    t, low, high = np.unravel_index(index, post.shape)
                    yield key, grid.low[low], grid.high[high], grid.tau[t]

        yield from _frames(per_plot(), [plot, *names], _draw_count(iterations))

    drawn = _in_small_batches(sums, plot, _sum_columns(plot), seed, iterations).mapInPandas(
        draw, f"{plot} {kind}, alpha_low array<double>, alpha_high array<double>, tau array<double>")
    return _draw_rows(drawn, plot, names, iterations)


def keep_draws(draws: DataFrame, iterations: Sequence[int] | None = None,
               variables: Sequence[str] | None = None) -> DataFrame:
    """Draws of the wanted iterations and variables for all plots at once."""
    if iterations is not None:
        draws = draws.filter(F.col("iteration").isin([int(i) for i in iterations]))
    if variables is not None:
        draws = draws.filter(F.col("variable").isin(list(variables)))
    return draws


def draw_summaries(draws: DataFrame, plot: str = "PLT_CN",
                   chains: int | None = None) -> DataFrame:
    """One summary row per (plot, variable, iteration) with the draw-row index, which is 1.

    ``chains`` is the number of rows per group where it is known, as for draws made here.
    """
    keys = [plot, "variable", "iteration"]
    return summarise_groups(draws, keys, "value", fixed_size=chains).withColumn(
        "multbayesnumber", F.lit(1).cast("int"))


def slope_table(summaries: DataFrame, sizes: DataFrame, plot: str = "PLT_CN") -> DataFrame:
    """Summaries with the plot's tree count and the slope of its exponents."""
    return (
        summaries.join(sizes.select(plot, "N_Trees"), on=plot, how="inner")
        .withColumn("corrected_slope", slope_from_exponent(F.col("variable"), F.col("mean")))
    )


def measured_slopes(draws: DataFrame, plot: str = "PLT_CN") -> DataFrame:
    """One row per plot from its draws of ``alpha``: corrected_slope, se_mean, sd."""
    return _measured(
        draws.filter(F.col("variable") == "alpha").groupBy(plot)
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
             F.count(F.lit(1)).alias("_n")), plot)


def _measured(moments: DataFrame, plot: str) -> DataFrame:
    return moments.select(
        plot, slope_from_exponent(F.lit("alpha"), F.col("mean")).alias("corrected_slope"),
        (F.col("sd") / F.sqrt("_n")).alias("se_mean"), "sd")


def drawn_slopes(sums: DataFrame, plot: str = "PLT_CN", seed: str = "draws",
                 grid: int = GRID) -> DataFrame:
    """``measured_slopes`` of all of ``pareto_draws``, whose draws stay in the task that makes them.

    The draws of a plot are the same ones; what leaves a task is one row per plot, so neither their
    uniform numbers nor the draws are rows or arrays of Spark.
    """
    kind = dict(sums.dtypes)[plot]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f"|{chain}|{i}".encode() for chain in range(1, CHAINS + 1)
                 for i in range(1, KEPT_ITERATIONS + 1)]
        for pdf in _plot_blocks(batches):
            a, w = _posterior_cells(pdf["N_Trees"].to_numpy(dtype=float),
                                    pdf["S"].to_numpy(dtype=float), grid)
            cum = np.cumsum(w, axis=1)
            mean, sd = np.empty(len(pdf)), np.empty(len(pdf))
            for i, key in enumerate(pdf["_key"]):
                times = _cell_counts(cum[i], _named_uniforms(key, names))
                own = np.flatnonzero(times)
                # Relative to one value, so that equal draws have no spread.
                away = a[i][own] - a[i][own[0]]
                mean[i] = (times[own] @ away) / len(names)
                sd[i] = math.sqrt((times[own] @ (away - mean[i]) ** 2) / (len(names) - 1))
                mean[i] += a[i][own[0]]
            yield pd.DataFrame({plot: pdf[plot].to_numpy(), "mean": mean, "sd": sd, "_n": len(names)})

    named = F.concat_ws("|", F.lit(seed), F.col(plot).cast("string")).alias("_key")
    moments = _spread(sums, plot).select(plot, "N_Trees", "S", named).mapInPandas(
        measure, f"{plot} {kind}, mean double, sd double, _n long")
    return _measured(moments, plot)
