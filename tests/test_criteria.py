"""WAIC of both fits against sums over every tree and grid point."""

import numpy as np

from canopyframe.operators import criteria, pareto
from tests.test_pareto import frame, pareto_sample, two_part_sample


def waic(log_density, weight):
    """Rows are trees, columns are grid points."""
    top = log_density.max(axis=1, keepdims=True)
    lppd = np.log((np.exp(log_density - top) * weight).sum(axis=1)) + top[:, 0]
    mean = (log_density * weight).sum(axis=1, keepdims=True)
    var = (weight * (log_density - mean) ** 2).sum(axis=1)
    elpd = lppd - var
    return lppd.sum(), var.sum(), elpd.sum(), -2 * elpd.sum(), np.sqrt(len(elpd) * elpd.var(ddof=1))


def values(row):
    return row.lppd, row.p_waic, row.elpd, row.waic, row.se


def samples():
    rng = np.random.default_rng(31)
    return {"one": pareto_sample(rng, 1.4, 900), "two": two_part_sample(rng, 0.5, 5.0, 25.0, 900),
            "few": pareto_sample(rng, 2.0, 3), "same": np.full(50, 20.0)}


def test_one_part_criteria(spark):
    xs = samples()
    got = {r.PLT_CN: r for r in criteria.one_part_criteria(frame(spark, xs)).collect()}
    for key, x in xs.items():
        n, s = np.array([float(len(x))]), np.array([np.log(x / 12.7).sum()])
        a, w = pareto._posterior_cells(n, s, pareto.GRID)
        dense = np.log(a[0]) + a[0] * np.log(12.7) - (a[0] + 1) * np.log(x)[:, None]
        assert np.allclose(values(got[key]), waic(dense, w[0] / w[0].sum()), rtol=1e-7, atol=1e-6)
        assert got[key].N_Trees == len(x)


def test_two_part_criteria_and_comparison(spark):
    xs = samples()
    df = frame(spark, xs)
    sums = pareto.resolved_sums(df, taus=24, alphas=24)
    two = criteria.two_part_criteria(df, sums, taus=24, alphas=24)
    got = {r.PLT_CN: r for r in two.collect()}
    for r in sums.collect():
        grid = pareto._TwoPartGrid(12.7, (r.tau_low, r.tau_high), 24, 24, r.ranges[:2], r.ranges[2:])
        post = grid.weights(r.N_Trees, r.N_Trees / r.W, r.bins).ravel()
        t, lo, hi = (v.ravel() for v in np.meshgrid(grid.tau, grid.low, grid.high, indexing="ij"))
        norm = -np.log(t ** (lo - hi) / lo * (12.7 ** -lo - t ** -lo) + t ** -hi / hi)
        x = xs[r.PLT_CN][:, None]
        dense = np.where(x < t, norm + (lo - hi) * np.log(t) - (lo + 1) * np.log(x),
                         norm - (hi + 1) * np.log(x))
        assert np.allclose(values(got[r.PLT_CN]), waic(dense, post), rtol=1e-6, atol=1e-6)
    better = {r.PLT_CN: r for r in criteria.compared(criteria.one_part_criteria(df), two).collect()}
    assert better["two"].better == "two_part" and better["two"].elpd_gain > 20
    assert abs(better["one"].elpd_gain) < 5


def test_cells_do_not_grow_with_the_trees(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, {"a": pareto_sample(rng, 1.4, 50_000)})
    assert criteria._cells(df, "PLT_CN", "DIA", 12.7, []).count() < 2_500
