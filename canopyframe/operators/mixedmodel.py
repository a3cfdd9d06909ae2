"""Slope regressions with known response error, region effects and an optional plot intercept.

    y_obs ~ Normal(l, error),  l ~ Normal(X b + region + plot, sigma)
    b ~ Normal(0, 5) except the intercept (flat), sigma ~ half-Normal(0, 2)
    region ~ Normal(0, sd^2 (D - a A)^-1) on the adjacency A, a in (0, 1)
    plot ~ Normal(0, sd_plot)

``l`` integrates out and leaves the weight 1 / (sigma^2 + error^2). For given variance parameters
everything else depends on the data only through weighted cross-products per (region, category),
which Spark sums for a small grid of sigmas in one pass. The grids start on the scale of the response
and are moved, widened and narrowed until they resolve the posterior. What reaches the driver is a table of
grid x regions x categories sums, whose size does not depend on the number of rows and is checked;
the remaining algebra has one unknown per coefficient and region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.functions.disturbance import levels_after_base
from canopyframe.session import materialize

MAX_CELLS = 500_000
PRIOR_SD = 5.0
SIGMA_PRIOR_SD = 2.0
HALF_T_DOF, HALF_T_SCALE = 3.0, 2.5
SPREAD_POINTS, PLOT_POINTS = 14, 12
# The neighbour parameter a in (0, 1) lies on a logarithmic axis of its odds a / (1 - a).
CAR_ODDS = (0.02, 200.0, 14)
# An axis is resolved once so many of its points hold over RESOLVED_SHARE of the mass each and
# neither end holds more than EDGE_SHARE.
RESOLVED_POINTS, RESOLVED_SHARE, EDGE_SHARE = 5, 0.02, 0.003
QUANTILES = {"q2_5": 0.025, "q50": 0.5, "q97_5": 0.975}
MOST_ROUNDS = 40            # of moving the axes; a fit that isn't resolved by then raises


@cache
def moment_name(i: int, j: int) -> str:
    return f"m_{min(i, j)}_{max(i, j)}"


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _moments(basis: list[str]) -> list[Column]:
    """Sums of w * basis_i * basis_j; one parsed expression each keeps plan building quick."""
    return [F.expr(f"sum(w * {basis[i]} * {basis[j]})").alias(moment_name(i, j))
            for i, j in _pairs(len(basis))]


def _basis(covariates: Sequence[str], y: str) -> list[str]:
    return ["1D", *[f"`{c}`" for c in covariates], f"`{y}`"]


def _weighted(rows: DataFrame, sigmas: Sequence[float]) -> DataFrame:
    grid = F.array(*[F.lit(float(s)) for s in sigmas])
    return rows.withColumn("sigma", F.explode(grid)).withColumn(
        "w", 1 / (F.col("sigma") * F.col("sigma") + F.col("error") * F.col("error")))


def cross_products(rows: DataFrame, sigmas: Sequence[float], covariates: Sequence[str],
                   category: str, region: str = "region", y: str = "y") -> DataFrame:
    """Weighted moments of (1, covariates, y) per (sigma, region, category).

    Dummy columns are constant inside a category, so their cross-products follow from these sums
    and are never computed per row. The sums combine on the map side into at most
    sigmas x regions x categories rows per task.
    """
    usable = rows.select(region, category, "error", y, *covariates).dropna()
    return _weighted(usable, sigmas).groupBy("sigma", region, category).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.ln("w")).alias("log_det"),
        *_moments(_basis(covariates, y)))


def plot_state(rows: DataFrame, covariates: Sequence[str], category: str,
               plot: str = "FINAL_PLT_ID", region: str = "region", y: str = "y") -> DataFrame:
    """Plain moments per (plot, region, category, error value), written once, in plot order.

    Rows of one plot and error share their weight whatever sigma is, so these sums are all that any
    sigma needs. They are dealt by ranges of (plot, error): a plot of any size spreads over tasks,
    all plots but the first and last of a partition are complete in it, and no pass over the state
    needs another shuffle of it.
    """
    usable = rows.select(plot, region, category, "error", y, *covariates).dropna()
    basis = _basis(covariates, y)
    sums = [F.expr(f"sum({basis[i]} * {basis[j]})").alias(moment_name(i, j))
            for i, j in _pairs(len(basis)) if j]
    order = [plot, region, category, "error"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = usable.groupBy(*order).agg(F.count(F.lit(1)).alias("n"), *sums)
    return materialize(state.repartitionByRange(parts, *order).sortWithinPartitions(*order))


def _plot_totals(sigmas: np.ndarray, keys: list[str], names: list[str]):
    """Folds a partition of the state: per plot and sigma the weighted moments.

    Yields (complete, key frame, n, log_det, moments): plots x sigmas (x moments) arrays; the first
    and last plot of the partition may go on in its neighbours and come as incomplete.
    """
    def totals(batches: Iterator[pd.DataFrame]):
        held = None
        first = True
        for pdf in batches:
            if not len(pdf):
                continue
            w = 1.0 / (sigmas[None, :] ** 2 + pdf["error"].to_numpy()[:, None] ** 2)
            n = pdf["n"].to_numpy(dtype=float)
            moments = np.column_stack([n] + [pdf[m].to_numpy(dtype=float) for m in names[1:]])
            own = pdf[keys].reset_index(drop=True)
            starts = np.flatnonzero(np.r_[True, (own.iloc[1:].to_numpy()
                                                 != own.iloc[:-1].to_numpy()).any(axis=1)])
            part = [own.iloc[starts].reset_index(drop=True), np.add.reduceat(n, starts),
                    np.add.reduceat(n[:, None] * np.log(w), starts, axis=0),
                    np.add.reduceat(w[:, :, None] * moments[:, None, :], starts, axis=0)]
            if held is not None:
                if (held[0].iloc[-1].to_numpy() == part[0].iloc[0].to_numpy()).all():
                    for k in (1, 2, 3):
                        part[k][0] += held[k][-1]
                    held = [v[:-1] for v in held]
                if len(held[0]):
                    if first:
                        yield (False, *(v[:1] for v in held))
                        held, first = [v[1:] for v in held], False
                    if len(held[0]):
                        yield (True, *held)
            # The last plot may go on in the next batch.
            cut = len(part[0]) - 1
            if cut and first:
                yield (False, *(v[:1] for v in part))
                first = False
                if cut > 1:
                    yield (True, *(v[1:cut] for v in part))
            elif cut:
                yield (True, *(v[:cut] for v in part))
            held = [v[cut:] for v in part]
        if held is not None:
            yield (False, *held)
    return totals


def _corrected(v: np.ndarray, n: np.ndarray, log_det: np.ndarray, m: np.ndarray, pairs):
    """Moments and log determinants of plots with an intercept of variance ``v`` integrated out."""
    inflation = 1.0 + v * m[..., 0]
    first = [m[..., pairs.index((0, i))] for i in range(pairs[-1][1] + 1)]
    return log_det - np.log(inflation), np.stack(
        [m[..., k] - v / inflation * first[i] * first[j] for k, (i, j) in enumerate(pairs)], axis=-1)


def plot_products(state: DataFrame, sigmas: Sequence[float], plot_sds: Sequence[float],
                  covariates: Sequence[str], category: str, plot: str = "FINAL_PLT_ID",
                  region: str = "region") -> DataFrame:
    """Moments under a random plot intercept per (sigma, sd_plot, region, category).

    Sigma is applied inside the tasks, to plots that lie whole in them. What leaves a task are its
    sums per region and category, once, and at most two unfinished plots.
    """
    kinds = dict(state.dtypes)
    pairs = _pairs(len(covariates) + 2)
    names = [moment_name(i, j) for i, j in pairs]
    keys = [plot, region, category]
    cells = [region, category]
    grid, spreads = np.asarray(sigmas, float), np.asarray(plot_sds, float)
    totals = _plot_totals(grid, keys, names)

    def long(frame: pd.DataFrame, points: int) -> pd.DataFrame:
        return frame.loc[frame.index.repeat(points)].reset_index(drop=True)

    def add(found: dict, own: pd.DataFrame, n, log_det, m) -> None:
        """Adds some complete plots to the sums per cell: n, (sd, sigma) and (sd, sigma, moment)."""
        cell, label = pd.factorize(pd.MultiIndex.from_frame(own[cells]))
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])
        counts = np.add.reduceat(n[order], starts)
        log_det, m = log_det[order], m[order]
        parts = [[np.add.reduceat(v, starts, axis=0) for v in _corrected(sd * sd, n, log_det, m, pairs)]
                 for sd in spreads]
        for k, key in enumerate(label):
            new = (counts[k], np.stack([ld[k] for ld, _ in parts]), np.stack([mm[k] for _, mm in parts]))
            found[key] = tuple(a + b for a, b in zip(found[key], new)) if key in found else new

    def summed(found: dict) -> pd.DataFrame:
        """Rows per (sigma, sd_plot, cell)."""
        points = len(spreads) * len(grid)
        frame = long(pd.DataFrame(list(found), columns=cells), points)
        frame["sigma"] = np.tile(grid, len(found) * len(spreads))
        frame["sd_plot"] = np.tile(np.repeat(spreads, len(grid)), len(found))
        frame["n"] = np.repeat([c for c, _, _ in found.values()], points).astype("int64")
        frame["log_det"] = np.concatenate([ld.ravel() for _, ld, _ in found.values()])
        moments = np.concatenate([mm.reshape(points, -1) for _, _, mm in found.values()])
        for k, name in enumerate(names):
            frame[name] = moments[:, k]
        frame[plot] = None
        frame["whole"] = True
        return frame[columns]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for complete, own, n, log_det, m in totals(batches):
            if complete:
                add(found, own, n, log_det, m)
                continue
            frame = long(own, len(grid))
            frame["sigma"] = np.tile(grid, len(own))
            frame["sd_plot"] = np.nan
            frame["n"] = np.repeat(n, len(grid)).astype("int64")
            frame["log_det"] = log_det.ravel()
            for k, name in enumerate(names):
                frame[name] = m[..., k].ravel()
            frame["whole"] = False
            yield frame[columns]
        if found:
            yield summed(found)

    columns = ["whole", plot, "sigma", "sd_plot", *cells, "n", "log_det", *names]
    types = ", ".join(f"`{c}` {kinds[c]}" for c in cells)
    numbers = ", ".join(f"{m} double" for m in names)
    folded = state.mapInPandas(
        fold, f"whole boolean, `{plot}` {kinds[plot]}, sigma double, sd_plot double, {types}, "
              f"n long, log_det double, {numbers}")

    def sums(frame: DataFrame, by: list[str]) -> DataFrame:
        return frame.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("log_det").alias("log_det"),
                                      *[F.sum(m).alias(m) for m in names])

    # The pieces of an unfinished plot come together, then its intercept is integrated out; whole
    # plots are done already, for which the variance counts as none.
    joined = sums(folded, ["whole", "sigma", "sd_plot", *keys])
    grid_sds = F.array(*[F.lit(float(s)) for s in spreads])
    v = "(if(whole, 0D, sd * sd))"
    inflation = f"(1 + {v} * m_0_0)"
    corrected = joined.withColumn("sd", F.explode(
        F.when(F.col("whole"), F.array("sd_plot")).otherwise(grid_sds))).select(
        "sigma", F.col("sd").alias("sd_plot"), *cells, "n",
        F.expr(f"log_det - ln({inflation})").alias("log_det"),
        *[F.expr(f"{moment_name(i, j)} - {v} / {inflation} * {moment_name(0, i)} "
                 f"* {moment_name(0, j)}").alias(moment_name(i, j)) for i, j in pairs])
    return sums(corrected, ["sigma", "sd_plot", *cells])


def plot_cross_products(rows: DataFrame, sigmas: Sequence[float], plot_sds: Sequence[float],
                        covariates: Sequence[str], category: str, plot: str = "FINAL_PLT_ID",
                        region: str = "region", y: str = "y") -> DataFrame:
    """``cross_products`` under a random plot intercept, per (sigma, sd_plot, region, category).

    Every plot must lie in one region and category (``plots_in_several_cells`` finds those that do
    not).
    """
    return plot_products(plot_state(rows, covariates, category, plot, region, y), sigmas, plot_sds,
                         covariates, category, plot, region)


def plots_in_several_cells(rows: DataFrame, plot: str, region: str, category: str) -> DataFrame:
    """Plots whose rows differ in region or category."""
    cell = F.xxhash64(region, category)
    return (rows.groupBy(plot).agg(F.min(cell).alias("_low"), F.max(cell).alias("_high"))
            .filter(F.col("_low") != F.col("_high")).select(plot))


# --- bounded algebra on the driver ---------------------------------------------------------------

@dataclass
class FittedModel:
    """Posterior mean, sd and 2.5, 50 and 97.5 % quantiles as small DataFrames."""

    coefficients: DataFrame
    regions: DataFrame
    spread: DataFrame

    def table(self) -> DataFrame:
        """Everything in one table: (part, name, mean, sd, q2_5, q50, q97_5)."""
        parts = {"coefficient": self.coefficients, "region": self.regions, "spread": self.spread}
        rows = None
        for part, df in parts.items():
            own = df.toDF("name", *df.columns[1:]).select(F.lit(part).alias("part"), "*")
            rows = own if rows is None else rows.unionByName(own)
        return rows


class _Region:
    """Adjacency of the regions, with the determinant of D - aA from one eigenproblem."""

    def __init__(self, names: list[str], edges: list[tuple[str, str]]):
        self.names = names
        place = {name: i for i, name in enumerate(names)}
        self.adjacency = np.zeros((len(names), len(names)))
        for a, b in edges:
            self.adjacency[place[a], place[b]] = 1.0
        self.degree = self.adjacency.sum(axis=1)
        if names and self.degree.min() <= 0:
            raise ValueError("a region has no neighbour")
        root = 1.0 / np.sqrt(self.degree)
        self.eigen = np.linalg.eigvalsh(self.adjacency * root[:, None] * root[None, :])
        self.log_degree = float(np.log(self.degree).sum())

    def precision(self, a: float) -> np.ndarray:
        return np.diag(self.degree) - a * self.adjacency

    def log_det(self, a: float) -> float:
        return self.log_degree + float(np.log1p(-a * self.eigen).sum())


class _System:
    """Normal equations of one (sigma, sd_plot) assembled from its cells."""

    def __init__(self, cells: list, covariates: int, levels: list[str], regions: list[str],
                 region: str, category: str):
        base = 1 + covariates
        p, r = base + len(levels), len(regions)
        self.p = p
        level_at = {name: base + i for i, name in enumerate(levels)}
        region_at = {name: p + i for i, name in enumerate(regions)}
        self.a = np.zeros((p + r, p + r))
        self.b = np.zeros(p + r)
        self.yy = self.log_det = 0.0
        y = base
        for cell in cells:
            # Columns that are non-zero in this cell, each a multiple of one basis column.
            columns = [(i, i) for i in range(base)]
            if cell[category] in level_at:
                columns.append((level_at[cell[category]], 0))
            if region_at:
                columns.append((region_at[cell[region]], 0))
            for row, i in columns:
                self.b[row] += cell[moment_name(i, y)]
                for col, j in columns:
                    self.a[row, col] += cell[moment_name(i, j)]
            self.yy += cell[moment_name(y, y)]
            self.log_det += cell["log_det"]

    def _with_prior(self, region_precisions: np.ndarray | None) -> np.ndarray:
        """One matrix per entry of ``region_precisions`` (or a single one without regions)."""
        count = 1 if region_precisions is None else len(region_precisions)
        a = np.repeat(self.a[None], count, axis=0)
        inner = np.arange(1, self.p)
        a[:, inner, inner] += 1.0 / PRIOR_SD ** 2
        if region_precisions is not None:
            a[:, self.p:, self.p:] += region_precisions
        return a

    def log_evidence(self, region_precisions: np.ndarray | None) -> np.ndarray:
        lower = np.linalg.cholesky(self._with_prior(region_precisions))
        rhs = np.broadcast_to(self.b[:, None], (len(lower), len(self.b), 1))
        half = np.linalg.solve(lower, rhs)[..., 0]
        log_diag = np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
        return (0.5 * (self.log_det - self.yy + (half ** 2).sum(axis=1)) - log_diag
                - (self.p - 1) * math.log(PRIOR_SD))

    def solve(self, region_precisions: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Means and variances of (coefficients, regions), one row per precision."""
        inverse = np.linalg.inv(self._with_prior(region_precisions))
        return inverse @ self.b, np.diagonal(inverse, axis1=1, axis2=2)


def _half_normal(x: float) -> float:
    return -0.5 * (x / SIGMA_PRIOR_SD) ** 2


def _half_t(x: float) -> float:
    return -(HALF_T_DOF + 1) / 2 * math.log1p((x / HALF_T_SCALE) ** 2 / HALF_T_DOF)


def _bounded_collect(df: DataFrame) -> list:
    rows = df.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} (grid, region, category) cells")
    return rows


def _moved(axis: np.ndarray, mass: np.ndarray) -> np.ndarray | None:
    """The next points of a logarithmic axis, or None if these resolve the mass.

    An end that holds mass is moved outwards; mass on too few points is looked at more closely.
    """
    ratio = axis[1] / axis[0]
    low, high = axis[0], axis[-1]
    if mass[0] > EDGE_SHARE or mass[-1] > EDGE_SHARE:
        # As many steps as would take in the mass if it fell off from here like the axis is wide.
        reach = max(ratio ** (len(axis) // 2), 1.05)
        held = np.flatnonzero(mass > 1e-6)
        low = low / reach if mass[0] > EDGE_SHARE else axis[max(held[0] - 1, 0)]
        high = high * reach if mass[-1] > EDGE_SHARE else axis[min(held[-1] + 1, len(axis) - 1)]
        return np.geomspace(low, high, len(axis))
    if (mass > RESOLVED_SHARE).sum() >= RESOLVED_POINTS:
        return None
    held = np.flatnonzero(mass > 1e-3)
    return np.geomspace(axis[max(held[0] - 1, 0)], axis[min(held[-1] + 1, len(axis) - 1)], len(axis))


def _car(odds: float) -> float:
    return odds / (1 + odds)


class _RegionGrid:
    """The (car odds, sd_region) grid with its precisions and log priors; one empty point without."""

    def __init__(self, regions: _Region | None, odds: np.ndarray, spreads: np.ndarray):
        if regions is None:
            self.points: list = [(None, None)]
            self.precisions = None
            self.log_prior = np.zeros(1)
            return
        self.points = [(float(o), float(spread)) for o in odds for spread in spreads]
        self.precisions = np.stack([regions.precision(_car(o)) / spread ** 2
                                    for o, spread in self.points])
        # Grids even in the logarithm weigh each point with its value; a step of the odds' logarithm
        # is one of a (1 - a) in the neighbour parameter, which is uniform.
        self.log_prior = np.array([
            0.5 * (regions.log_det(_car(o)) - 2 * len(regions.names) * math.log(spread))
            + _half_t(spread) + math.log(spread) + math.log(o) - 2 * math.log1p(o)
            for o, spread in self.points])

    def precision(self, indexes: list[int]) -> np.ndarray | None:
        return None if self.precisions is None else self.precisions[indexes]


def _posterior_mass(systems: dict, grid: _RegionGrid) -> dict:
    """(sigma, sd_plot, index into the region grid) -> posterior mass."""
    logs = {}
    for (sigma, plot_sd), system in systems.items():
        own = _half_normal(sigma) + math.log(sigma)
        if plot_sd is not None and plot_sd > 0:
            own += _half_t(plot_sd) + math.log(plot_sd)
        logs[sigma, plot_sd] = own + grid.log_prior + system.log_evidence(grid.precisions)
    peak = max(float(v.max()) for v in logs.values())
    mass = {(*point, i): math.exp(float(x) - peak)
            for point, values in logs.items() for i, x in enumerate(values)}
    whole = sum(mass.values())
    return {k: v / whole for k, v in mass.items()}


def _axis_mass(mass: dict, axis: np.ndarray, of) -> np.ndarray:
    total = dict.fromkeys(map(float, axis), 0.0)
    for point, p in mass.items():
        total[float(of(point))] += p
    return np.array(list(total.values()))


def _fit(rows: DataFrame, sums, covariates: Sequence[str], category: str, base: str,
         edges: DataFrame | None, region: str, y: str, sigma_points: int,
         sigmas: Sequence[float] | None, plot_sds: Sequence[float] | None,
         with_plots: bool) -> FittedModel:
    """Moves the sigma, plot and region axes until all are resolved; given axes stay as they are.

    One scan of ``rows`` for every new sigma or plot axis; the region axis needs none.
    """
    spark = rows.sparkSession
    scale = rows.agg(F.stddev_samp(y)).first()[0] or 1.0
    sigma = np.asarray(sigmas, float) if sigmas is not None else np.geomspace(
        scale / 100.0, scale * 2.0, sigma_points)
    plot = None
    if with_plots:
        plot = np.asarray(plot_sds, float) if plot_sds is not None else np.geomspace(
            scale / 100.0, scale * 2.0, PLOT_POINTS)
    spread = np.geomspace(scale / 100.0, scale * 10.0, SPREAD_POINTS)
    odds = np.geomspace(*CAR_ODDS)
    regions = None
    if edges is not None:
        pairs = [(r.region_a, r.region_b) for r in _bounded_collect(edges)]
        regions = _Region(sorted({a for a, _ in pairs}), pairs)
    systems: dict = {}
    for _ in range(MOST_ROUNDS):
        if not systems:
            cells = [c.asDict() for c in _bounded_collect(sums(sigma, plot))]
            if not cells:
                raise ValueError("no complete row to fit")
            levels = levels_after_base({c[category] for c in cells}, base)
            by_point: dict = {}
            for c in cells:
                by_point.setdefault((c["sigma"], c.get("sd_plot")), []).append(c)
            systems = {point: _System(found, len(covariates), levels,
                                      regions.names if regions else [], region, category)
                       for point, found in by_point.items()}
        region_grid = _RegionGrid(regions, odds, spread)
        mass = _posterior_mass(systems, region_grid)
        next_sigma = next_plot = next_spread = next_odds = None
        if sigmas is None:
            next_sigma = _moved(sigma, _axis_mass(mass, sigma, lambda k: k[0]))
        if plot is not None and plot_sds is None:
            next_plot = _moved(plot, _axis_mass(mass, plot, lambda k: k[1]))
        if regions is not None:
            next_spread = _moved(spread, _axis_mass(
                mass, spread, lambda k: region_grid.points[k[2]][1]))
            next_odds = _moved(odds, _axis_mass(mass, odds, lambda k: region_grid.points[k[2]][0]))
        spread = spread if next_spread is None else next_spread
        odds = odds if next_odds is None else next_odds
        if next_sigma is not None or next_plot is not None:
            sigma = sigma if next_sigma is None else next_sigma
            plot = plot if next_plot is None else next_plot
            systems = {}
        elif next_spread is None and next_odds is None:
            return _summaries(spark, systems, mass, regions, region_grid, covariates, levels)
    raise RuntimeError(f"the variance parameters are not resolved after {MOST_ROUNDS} rounds")


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26; off by 1e-7 at most."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (
        -1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z < 0, tail / 2, 1 - tail / 2)


def mixture_quantiles(weights: np.ndarray, means: np.ndarray, sds: np.ndarray,
                      probs: Sequence[float]) -> np.ndarray:
    """Quantiles (probs x columns) of mixtures of normals: points x columns, by bisection."""
    weights = weights / weights.sum()
    out = []
    for prob in probs:
        low = (means - 8 * sds).min(axis=0)
        high = (means + 8 * sds).max(axis=0)
        for _ in range(50):
            middle = (low + high) / 2
            below = weights @ _normal_cdf((middle[None, :] - means) / sds) < prob
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        out.append((low + high) / 2)
    return np.array(out)


def _finer(logs: np.ndarray, times: int) -> np.ndarray:
    """Values between evenly spaced ones by cubics through four neighbours (ends: slope kept)."""
    padded = np.r_[2 * logs[0] - logs[1], logs, 2 * logs[-1] - logs[-2]]
    u = np.arange(times) / times
    rows = []
    for k in range(len(logs) - 1):
        a, b, c, d = padded[k:k + 4]
        rows.append(b + u / 2 * (c - a + u * (2 * a - 5 * b + 4 * c - d
                                             + u * (3 * (b - c) + d - a))))
    return np.r_[np.concatenate(rows), logs[-1]]


def axis_quantiles(axis: np.ndarray, mass: np.ndarray, probs: Sequence[float],
                   times: int = 40) -> list[float]:
    """Quantiles of a marginal known on a logarithmic axis."""
    if len(axis) < 3:
        return [float(axis[min(np.searchsorted(np.cumsum(mass), p * mass.sum()), len(axis) - 1)])
                for p in probs]
    logs = np.log(np.maximum(mass, 1e-300))
    fine = np.exp(_finer(np.maximum(logs, logs.max() - 60), times))
    at = np.linspace(np.log(axis[0]), np.log(axis[-1]), len(fine))
    cum = np.r_[0, np.cumsum((fine[1:] + fine[:-1]) / 2)]
    return [float(np.exp(np.interp(p * cum[-1], cum, at))) for p in probs]


def _summaries(spark, systems: dict, mass: dict, regions: _Region | None, grid: _RegionGrid,
               covariates: Sequence[str], levels: list[str]) -> FittedModel:
    kept: dict[tuple, list[tuple[int, float]]] = {}
    for point, p in mass.items():
        if p >= 1e-7:
            kept.setdefault(point[:2], []).append((point[2], p))
    solved = [systems[point].solve(grid.precision([k for k, _ in own])) for point, own in kept.items()]
    weights = np.array([p for own in kept.values() for _, p in own])
    means = np.concatenate([m for m, _ in solved])
    sds = np.sqrt(np.concatenate([v for _, v in solved]))
    weights /= weights.sum()
    mean = weights @ means
    sd = np.sqrt(np.maximum(weights @ (sds ** 2 + means ** 2) - mean ** 2, 0.0))
    probs = list(QUANTILES.values())
    quantiles = mixture_quantiles(weights, means, sds, probs)
    terms = ["Intercept", *covariates, *levels]
    names = regions.names if regions else []
    spread = []
    # The axes by name, and how a point of the axis reads.
    axes = {"sigma": (lambda k: k[0], float), "sd_plot": (lambda k: k[1], float),
            "car": (lambda k: grid.points[k[2]][0], _car),
            "sd_region": (lambda k: grid.points[k[2]][1], float)}
    for name, (of, read) in axes.items():
        if of(next(iter(mass))) is None:
            continue
        total: dict[float, float] = {}
        for k, p in mass.items():
            total[of(k)] = total.get(of(k), 0.0) + p
        points = np.array(sorted(total))
        own = np.array([total[v] for v in points])
        shown = np.array([read(v) for v in points])
        m = float(own @ shown)
        v = float(own @ (shown - m) ** 2)
        q = axis_quantiles(points, own, probs) if points[0] > 0 else [
            float(points[min(np.searchsorted(np.cumsum(own), p), len(points) - 1)]) for p in probs]
        spread.append((name, m, math.sqrt(v), *map(read, q)))
    numbers = ", ".join(f"{c} double" for c in ("mean", "sd", *QUANTILES))

    def frame(labels: list[str], start: int, column: str) -> DataFrame:
        rows = [(label, *map(float, (mean[start + i], sd[start + i], *quantiles[:, start + i])))
                for i, label in enumerate(labels)]
        return spark.createDataFrame(rows, f"{column} string, {numbers}")

    return FittedModel(frame(terms, 0, "term"), frame(names, len(terms), "region"),
                       spark.createDataFrame(spread, f"name string, {numbers}"))


def fit_region_model(rows: DataFrame, edges: DataFrame | None, covariates: Sequence[str],
                     category: str, base: str, region: str = "region", y: str = "y",
                     sigma_points: int = 15, sigmas: Sequence[float] | None = None) -> FittedModel:
    """Regression with response error and, given ``edges``, spatially structured regions.

    The grids of the variance parameters are moved until they resolve the posterior, else the fit
    raises; ``sigmas`` fixes that axis. Every new sigma axis is one scan of ``rows``; cache or write
    them first if they are expensive to compute.
    """
    def sums(grid, _):
        return cross_products(rows, grid, covariates, category, region, y)

    return _fit(rows, sums, covariates, category, base, edges, region, y, sigma_points, sigmas, None,
                False)


def fit_region_plot_model(rows: DataFrame, edges: DataFrame | None, covariates: Sequence[str],
                          category: str, base: str, plot: str = "FINAL_PLT_ID",
                          region: str = "region", y: str = "y", sigma_points: int = 12,
                          plot_sds: Sequence[float] | None = None,
                          sigmas: Sequence[float] | None = None) -> FittedModel:
    """``fit_region_model`` with a random intercept per plot."""
    usable = rows.select(plot, region, category, "error", y, *covariates).dropna()
    mixed = plots_in_several_cells(usable, plot, region, category).take(5)
    if mixed:
        names = ", ".join(str(r[0]) for r in mixed[:4]) + (" and more" if len(mixed) > 4 else "")
        raise ValueError(f"plots in more than one region or category: {names}")

    state = plot_state(rows, covariates, category, plot, region, y)

    def sums(grid, spreads):
        return plot_products(state, grid, spreads, covariates, category, plot, region)

    return _fit(rows, sums, covariates, category, base, edges, region, y, sigma_points, sigmas,
                plot_sds, True)
