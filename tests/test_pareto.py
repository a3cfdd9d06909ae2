import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyframe.functions.twopart import two_part_log_density
from canopyframe.operators import pareto
from canopyframe.plans import slopes


def pareto_sample(rng, alpha, n, x_min=12.7):
    return x_min * (1 - rng.random(n)) ** (-1 / alpha)


def two_part_sample(rng, low, high, tau, n, x_min=12.7):
    """Inverse of the two-part distribution function."""
    below = (x_min ** -low - tau ** -low) / low * tau ** (low - high)
    above = tau ** -high / high
    u = rng.random(n) * (below + above)
    inner = x_min ** -low - np.minimum(u, below) * low * tau ** (high - low)
    outer = tau ** -high - np.maximum(u - below, 0) * high
    return np.where(u < below, inner ** (-1 / low), outer ** (-1 / high))


def frame(spark, samples, parts=4):
    rows = [(k, float(x), 1.0 + i % 3) for k, xs in samples.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "PLT_CN string, DIA double, TPA_UNADJ double"
                                 ).repartition(parts)


@pytest.mark.parametrize("low,high,tau", [(1.2, 4.0, 30.0), (0.3, 0.9, 20.0), (4.0, 9.0, 45.0)])
def test_density_integrates_to_one_and_is_continuous(spark, low, high, tau):
    grid = np.concatenate([np.linspace(12.7, tau, 4001)[:-1], np.geomspace(tau, 1e7, 20001)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(grid)], "i int, x double")
    density = np.exp([r[1] for r in df.select("i", two_part_log_density(
        F.col("x"), F.lit(low), F.lit(high), F.lit(tau), F.lit(12.7))).orderBy("i").collect()])
    tail = density[-1] * grid[-1] / high
    assert abs(np.trapezoid(density, grid) + tail - 1) < 1e-4
    ends = spark.createDataFrame([(tau * (1 - 1e-12),), (tau,)], "x double").select(
        two_part_log_density(F.col("x"), F.lit(low), F.lit(high), F.lit(tau), F.lit(12.7)))
    a, b = (r[0] for r in ends.collect())
    assert abs(a - b) < 1e-9


def test_one_part_fit_against_direct_integration(spark):
    rng = np.random.default_rng(1)
    samples = {"small": pareto_sample(rng, 1.7, 12), "mid": pareto_sample(rng, 0.8, 150),
               "big": pareto_sample(rng, 2.2, 60_000), "steep": pareto_sample(rng, 9.0, 500),
               "flat": np.full(5, 12.7)}
    got = {r.PLT_CN: r for r in pareto.fit_pareto(
        pareto.pareto_sums(frame(spark, samples))).collect()}
    for key, xs in samples.items():
        n, s = len(xs), np.log(xs / 12.7).sum()
        a = np.linspace(0, 5, 400_001)[1:-1]
        lp = (n - 1) * np.log(a) - a * s - (np.log(a) - 1) ** 2 / 2
        w = np.exp(lp - lp.max())
        mean = (a * w).sum() / w.sum()
        sd = np.sqrt((w * (a - mean) ** 2).sum() / w.sum())
        assert abs(got[key].alpha_mean - mean) < 0.01 * sd + 1e-4, key
        assert abs(got[key].alpha_sd - sd) < 0.02 * sd, key
        assert got[key].N_Trees == n
        assert got[key].corrected_slope == -(got[key].alpha_mean + 1)
        cum = np.cumsum(w) / w.sum()
        for name, p in (("q5", 0.05), ("median", 0.5), ("q95", 0.95)):
            assert abs(got[key][name] - a[np.searchsorted(cum, p)]) < 0.12 * sd + 0.006
    assert abs(got["big"].alpha_mean - got["big"].alpha_mle) < 1e-3


def test_rows_below_the_minimum_and_missing_sizes(spark):
    df = spark.createDataFrame([("a", 20.0), ("a", 5.0), ("a", None), ("b", 1.0)],
                               "PLT_CN string, DIA double")
    rows = pareto.pareto_sums(df).collect()
    assert [(r.PLT_CN, r.N_Trees, r.N_below) for r in rows] == [("a", 1, 1)]


def test_weights(spark):
    rng = np.random.default_rng(2)
    samples = {"a": pareto_sample(rng, 1.5, 300)}
    df = frame(spark, samples)
    row = pareto.pareto_sums(df, weight="TPA_UNADJ").first()
    w = 1.0 + np.arange(300) % 3
    assert np.isclose(row.S, (w * np.log(samples["a"] / 12.7)).sum() * 300 / w.sum())
    plain = pareto.pareto_sums(df).first()
    even = pareto.pareto_sums(df.withColumn("TPA_UNADJ", F.lit(3.5)), weight="TPA_UNADJ").first()
    assert np.isclose(plain.S, even.S) and plain.N_Trees == even.N_Trees
    two = pareto.fit_two_part(pareto.two_part_sums(df, weight="TPA_UNADJ", taus=8), taus=8,
                              alphas=8)
    assert two.count() == 3


def test_weighted_thinned_slopes(spark):
    """Whole weights that are the same for all trees of a plot change nothing; others do."""
    rng = np.random.default_rng(2)
    df = frame(spark, {"a": pareto_sample(rng, 1.5, 60), "b": pareto_sample(rng, 0.9, 40)})
    for two_part in (True, False):
        options = {"inches": False, "two_part": two_part}
        key = lambda r: (r.PLT_CN, r.variable, r.iteration)
        plain = {key(r): r["mean"] for r in slopes.thinned_slopes(df, **options).collect()}
        even = {key(r): r["mean"] for r in slopes.thinned_slopes(
            df.withColumn("TPA_UNADJ", F.lit(2.0)), weight="TPA_UNADJ", **options).collect()}
        assert plain.keys() == even.keys() and all(np.isclose(plain[k], even[k]) for k in plain)
        other = {key(r): r["mean"] for r in slopes.thinned_slopes(
            df, weight="TPA_UNADJ", **options).collect()}
        assert any(not np.isclose(plain[k], other[k]) for k in plain)


def test_measured_slopes_feed_the_slope_models(spark):
    rng = np.random.default_rng(21)
    df = frame(spark, {"a": pareto_sample(rng, 1.5, 60)})
    fit = pareto.fit_pareto(pareto.pareto_sums(df)).first()
    row = slopes.full_draw_measurements(df, inches=False).first()
    assert abs(row.corrected_slope - fit.corrected_slope) < 0.05 * fit.alpha_sd
    assert np.isclose(row.se_mean, row.sd / np.sqrt(12_000)) and row.N_Trees == 60


def test_two_part_recovers_parameters_for_any_partitioning(spark):
    rng = np.random.default_rng(4)
    samples = {"a": two_part_sample(rng, 1.2, 4.0, 30.0, 4000),
               "b": two_part_sample(rng, 0.6, 2.5, 22.0, 4000)}
    fits = []
    for parts in (1, 7):
        rows = slopes.two_part_slopes(frame(spark, samples, parts), inches=False).collect()
        fits.append({(r.PLT_CN, r.variable): r for r in rows})
    first, second = fits
    for key, r in first.items():
        assert np.isclose(r["mean"], second[key]["mean"], rtol=1e-9)
    for plot, truth in (("a", (1.2, 4.0, 30.0)), ("b", (0.6, 2.5, 22.0))):
        for name, value in zip(("alpha_low", "alpha_high", "tau"), truth):
            assert abs(first[plot, name]["mean"] - value) < max(0.12 * value, 0.15), (plot, name)
            assert first[plot, name].edge_mass < 0.01
    assert first["a", "tau"].corrected_slope is None
    assert np.isclose(first["a", "alpha_low"].corrected_slope,
                      -(first["a", "alpha_low"]["mean"] + 1))


@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000])
def test_many_trees_resolve_break_and_exponents(spark, n):
    rng = np.random.default_rng(n)
    xs = two_part_sample(rng, 1.2, 4.0, 30.0, n)
    df = spark.createDataFrame(pd.DataFrame({"PLT_CN": "a", "DIA": xs})).repartition(4)
    fine = {r.variable: r for r in pareto.fit_two_part(pareto.resolved_sums(df)).collect()}
    for name, truth in (("alpha_low", 1.2), ("alpha_high", 4.0), ("tau", 30.0)):
        row = fine[name]
        assert row.sd > 0 and abs(row["mean"] - truth) < 4 * row.sd, name
        assert row.edge_mass < 1e-3
        # Standard deviations fall with the root of the number of trees.
        assert row.sd < {"alpha_low": 10, "alpha_high": 20, "tau": 90}[name] / np.sqrt(n), name


def dense_two_part(xs, low, high, tau, cells=120, x_min=12.7):
    """Means and standard deviations on one dense grid over given ranges."""
    mid = lambda r: r[0] + (r[1] - r[0]) * (np.arange(cells) + 0.5) / cells
    t, lo, hi = mid(tau)[:, None, None], mid(low)[None, :, None], mid(high)[None, None, :]
    logs = np.log(np.sort(xs))
    k = np.searchsorted(np.sort(xs), t)
    s_low = np.r_[0, np.cumsum(logs)][k]
    norm = -np.log(t ** (lo - hi) / lo * (x_min ** -lo - t ** -lo) + t ** -hi / hi)
    lp = (len(xs) * norm + k * (lo - hi) * np.log(t) - (lo + 1) * s_low
          - (hi + 1) * (logs.sum() - s_low) - np.log(lo) - (np.log(lo) - 1) ** 2 / 2
          - np.log(hi) - (np.log(hi) - 1) ** 2 / 2)
    w = np.exp(lp - lp.max())
    out = {}
    for name, values in (("alpha_low", lo), ("alpha_high", hi), ("tau", t)):
        mean = (w * values).sum() / w.sum()
        out[name] = (mean, np.sqrt((w * (values - mean) ** 2).sum() / w.sum()))
    return out


def test_resolved_fit_equals_dense_integration_also_beside_a_hot_plot(spark):
    """One plot holds nine tenths of the rows and needs further passes, the others don't."""
    rng = np.random.default_rng(15)
    samples = {"hot": two_part_sample(rng, 1.5, 3.5, 25.0, 30_000),
               "few": two_part_sample(rng, 1.0, 3.0, 25.0, 15),
               "some": two_part_sample(rng, 0.4, 5.0, 40.0, 400),
               "flat": np.full(40, 13.0)}
    sums = pareto.resolved_sums(frame(spark, samples))
    kept = {r.PLT_CN: r for r in sums.collect()}
    assert kept["hot"].tau_high - kept["hot"].tau_low < 10 < kept["few"].tau_high - kept["few"].tau_low
    got = {(r.PLT_CN, r.variable): r for r in pareto.fit_two_part(sums).collect()}
    for key, xs in samples.items():
        r = kept[key]
        want = dense_two_part(xs, r.ranges[:2], r.ranges[2:], (r.tau_low, r.tau_high))
        for name, (mean, sd) in want.items():
            assert abs(got[key, name]["mean"] - mean) < 0.06 * sd, (key, name)
            assert abs(got[key, name].sd / sd - 1) < 0.06, (key, name)
            assert got[key, name].N_Trees == len(xs)


def test_counts_of_left_out_rows_and_plots(spark):
    df = spark.createDataFrame(
        [("a", 20.0, 1.0), ("a", 5.0, 1.0), ("a", 30.0, None), ("a", None, 1.0), ("b", 1.0, 1.0)],
        "PLT_CN string, DIA double, TPA_UNADJ double")
    rows = {r.PLT_CN: tuple(r)[1:] for r in pareto.tree_counts(df).collect()}
    assert rows == {"a": (4, 1, 1, 2, True), "b": (1, 0, 1, 0, False)}
    rows = {r.PLT_CN: tuple(r)[1:] for r in pareto.tree_counts(df, weight="TPA_UNADJ").collect()}
    assert rows == {"a": (4, 2, 1, 1, True), "b": (1, 0, 1, 0, False)}
    assert [(r.N_Trees, r.N_below) for r in pareto.fit_pareto(pareto.pareto_sums(df)).collect()] == [(2, 1)]
    two = pareto.fit_two_part(pareto.resolved_sums(df)).collect()
    assert {(r.PLT_CN, r.N_Trees, r.N_below) for r in two} == {("a", 2, 1)}
    weighted = pareto.two_part_sums(df, weight="TPA_UNADJ").collect()
    assert [(r.PLT_CN, r.N_Trees, r.N_below) for r in weighted] == [("a", 1, 1)]


def test_too_few_cells_cannot_resolve(spark):
    df = frame(spark, {"a": np.array([20.0, 30.0])})
    with pytest.raises(ValueError):
        pareto.resolved_sums(df, alphas=10)


def test_two_part_grid_equals_pointwise_likelihood(spark):
    rng = np.random.default_rng(6)
    xs = two_part_sample(rng, 1.0, 3.0, 25.0, 80)
    sums = pareto.two_part_sums(frame(spark, {"a": xs}), taus=6).first()
    grid = pareto._TwoPartGrid(12.7, (12.7, 50.0), 6, 5)
    got = grid.weights(sums.N_Trees, sums.N_Trees / sums.W, sums.bins)
    want = np.zeros_like(got)
    for i, t in enumerate(grid.tau):
        for j, lo in enumerate(grid.low):
            for k, hi in enumerate(grid.high):
                c = t ** (lo - hi)
                norm = 1 / (c / lo * (12.7 ** -lo - t ** -lo) + t ** -hi / hi)
                p = np.where(xs < t, c * norm * xs ** -(lo + 1), norm * xs ** -(hi + 1))
                want[i, j, k] = (np.log(p).sum() - np.log(lo) - (np.log(lo) - 1) ** 2 / 2
                                 - np.log(hi) - (np.log(hi) - 1) ** 2 / 2)
    want = np.exp(want - want.max())
    assert np.allclose(got, want / want.sum(), atol=1e-12)


def test_pointwise_likelihood_uses_each_plots_parameters(spark):
    trees = spark.createDataFrame([("a", 20.0), ("a", 40.0), ("b", 20.0), ("c", 20.0), ("a", 1.0)],
                                  "PLT_CN string, DIA double")
    parameters = spark.createDataFrame([("a", 1.0, 2.0, 30.0), ("b", 2.0, 3.0, 15.0)],
                                       "PLT_CN string, alpha_low double, alpha_high double, "
                                       "tau double")
    rows = pareto.pointwise_log_likelihood(trees, parameters).collect()
    assert sorted(r.PLT_CN for r in rows) == ["a", "a", "b"]


def test_thinned_iterations():
    assert pareto.thinned_iterations() == [100, 422, 744, 1067, 1389, 1711, 2033, 2356, 2678, 3000]


def test_draws_follow_the_posterior_and_subset_exactly(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, {"a": pareto_sample(rng, 1.5, 40), "b": pareto_sample(rng, 0.7, 90)})
    sums = pareto.pareto_sums(df)
    fit = {r.PLT_CN: r for r in pareto.fit_pareto(sums).collect()}
    full = pareto.pareto_draws(sums).toPandas()
    assert len(full) == 2 * 4 * 3000
    for key, part in full.groupby("PLT_CN"):
        assert abs(part["value"].mean() - fit[key].alpha_mean) < 0.04 * fit[key].alpha_sd + 0.005
        assert abs(part["value"].std() - fit[key].alpha_sd) < 0.05 * fit[key].alpha_sd
    some = pareto.pareto_draws(sums.repartition(5), iterations=[100, 3000]).toPandas()
    merged = some.merge(full, on=["PLT_CN", "variable", "chain", "iteration"])
    assert len(merged) == len(some) == 16 and (merged.value_x == merged.value_y).all()
    kept = pareto.keep_draws(spark.createDataFrame(full), [100, 3000], ["alpha"])
    assert kept.count() == 16


def test_thinned_slopes(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, {"a": two_part_sample(rng, 1.2, 4.0, 30.0, 400),
                       "b": two_part_sample(rng, 1.2, 4.0, 30.0, 100)})
    rows = slopes.thinned_slopes(df, inches=False).collect()
    assert len(rows) == 2 * 3 * 10
    assert {r.N_Trees for r in rows if r.PLT_CN == "b"} == {100}
    for r in rows:
        assert r.multbayesnumber == 1 and r.iteration in pareto.thinned_iterations()
        if r.variable == "tau":
            assert r.corrected_slope is None and 12.7 < r["mean"] < 50
        else:
            assert np.isclose(r.corrected_slope, -(r["mean"] + 1))
