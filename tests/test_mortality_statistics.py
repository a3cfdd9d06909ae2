import numpy as np
import pytest

from canopyframe.functions.student import t_quantile, two_sided_p
from canopyframe.operators import density2d, mortality, regression
from canopyframe.plans import mortality_check
from conftest import as_dict

MORT = "pltID string, YEAR int, PLT_CN string, MORT_PERC double"
TREES = ("PLT_CN string, INVYR int, pltID string, Disturbance string, TRE_CN string, DIA double")


def test_history(spark):
    df = spark.createDataFrame([
        ("a", 2001, "a1", 5.0), ("a", 2003, "a2", None), ("a", 2005, "a3", 9.0),
        ("a", 2007, "a4", 9.0), ("a", 2009, "a5", 1.0),
        ("b", 2001, "b1", float("nan")), ("b", 2001, "b2", 3.0)], MORT)
    rows = {r.PLT_CN: r for r in mortality.mortality_history(df).collect()}
    assert [rows[f"a{i}"].Max_Mort for i in range(1, 6)] == [5, 5, 9, 9, 9]
    assert [rows[f"a{i}"].Max_Mort_Year for i in range(1, 6)] == [2001, 2001, 2005, 2005, 2005]
    assert [rows[f"a{i}"].Years_Since_Max_Mort for i in range(1, 6)] == [0, 2, 0, 2, 4]
    assert rows["b1"].MORT_PERC == 0.0 and rows["b1"].Max_Mort == rows["b2"].Max_Mort == 3.0


def event_data(spark):
    mort = spark.createDataFrame([
        ("a", 2001, "a1", 50.0), ("a", 2006, "a2", 1.0),     # peak in the disturbed year
        ("b", 2001, "b1", 1.0), ("b", 2006, "b2", 50.0),     # disturbed later than first peak
        ("c", 2001, "c1", 9.0), ("c", 2006, "c2", 9.0)], MORT)  # disturbed twice
    rows = []
    for visit, year, plot, disturbed in (("a1", 2001, "a", "Yes"), ("a2", 2006, "a", "No"),
                                         ("b1", 2001, "b", "No"), ("b2", 2006, "b", "Yes"),
                                         ("c1", 2001, "c", "Yes"), ("c2", 2006, "c", "Yes"),
                                         ("z1", 2001, "z", "Yes")):
        rows += [(visit, year, plot, disturbed, f"{visit}-{i}", 4.0 + i) for i in range(5)]
    return spark.createDataFrame(rows, TREES), mort


def test_single_disturbance_and_event_trees(spark):
    trees, mort = event_data(spark)
    single = mortality_check.disturbance_and_mortality(trees, mort)
    assert {(r.pltID, r.PLT_CN, r.Year_of_Disturbance) for r in single.collect()} == {
        ("a", "a1", 2001), ("a", "a2", 2001), ("b", "b1", 2006), ("b", "b2", 2006)}
    assert as_dict(mortality.one_row_per_plot(single), "pltID", "Max_Mort_Year") == {
        "a": 2001, "b": 2001}
    assert [r.PLT_CN for r in mortality.matching_event_visits(single).collect()] == ["a1"]
    out = mortality_check.analysis_trees(trees, mort, min_trees=3).collect()
    assert sorted(round(r.DIA / 2.54, 6) for r in out) == [6, 7, 8]
    assert {(r.N_trees, r.Plot_Num, r.Year_of_Disturbance) for r in out} == {(3, 1, 2001)}
    assert mortality_check.analysis_trees(trees, mort, min_trees=4).count() == 0


def test_plot_mortality(spark):
    tree = spark.createDataFrame([
        ("1", None, "p", 2001, "v1", 1, 2.0), ("2", None, "p", 2001, "v1", 1, 6.0),
        ("3", None, "p", 2001, "v1", 2, 5.0), ("1b", "1", "p", 2006, "v2", 2, 0.0),
        ("2b", "2", "p", 2006, "v2", 1, 6.0), ("3b", "3", "p", 2006, "v2", 2, 5.0)],
        "CN string, PREV_TRE_CN string, pltID string, INVYR int, PLT_CN string, STATUSCD int, "
        "TPA_UNADJ double")
    rows = mortality.plot_mortality(tree).collect()
    assert [(r.pltID, r.YEAR, r.MORT_PERC) for r in rows] == [("p", 2006, 25.0)]


def sample_points(spark, n=500):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(10, 3, n), 1)
    y = 2 + 0.5 * x + rng.normal(0, 1.5, n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "u double, v double")
    return x, y, regression.complete_points(df, "u", "v")


def test_student_t():
    assert abs(two_sided_p(2.0, 10) - 0.0733880) < 1e-6
    assert abs(two_sided_p(0.0, 5) - 1.0) < 1e-12
    assert abs(t_quantile(0.975, 10) - 2.2281389) < 1e-6
    assert abs(t_quantile(0.975, 1) - 12.7062047) < 1e-5


def test_regression_summary(spark):
    x, y, points = sample_points(spark)
    design = np.column_stack([np.ones_like(x), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    residual = y - design @ beta
    sigma2 = residual @ residual / (len(x) - 2)
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(design.T @ design)))
    sums = regression.regression_sums(points)
    row = regression.with_p_values(regression.with_errors(sums)).first()
    assert np.allclose([row.intercept, row.slope], beta)
    assert np.allclose([row.intercept_se, row.slope_se], se)
    assert np.isclose(row.sigma, np.sqrt(sigma2)) and row.dof == len(x) - 2
    assert np.isclose(row.r_squared, 1 - residual @ residual / ((y - y.mean()) ** 2).sum())
    assert np.isclose(row.f_statistic, (beta[1] / se[1]) ** 2)
    assert row.slope_p < 1e-10 and 0 < row.intercept_p < 1
    quartiles = regression.residual_quartiles(points, sums).first()
    assert np.allclose(list(quartiles), np.quantile(residual, [0, 0.25, 0.5, 0.75, 1]))
    assert np.isclose(regression.correlation(points).first()[0], np.corrcoef(x, y)[0, 1])


def test_fitted_line_band(spark):
    x, y, points = sample_points(spark)
    rows = regression.fitted_line(points, steps=5).orderBy("x").collect()
    assert np.allclose([r.x for r in rows], np.linspace(x.min(), x.max(), 5))
    for r in rows:
        assert np.isclose(r.upper - r.fit, t_quantile(0.975, len(x) - 2) * r.se)
        assert np.isclose(r.fit - r.lower, r.upper - r.fit)


def test_two_points_have_no_error(spark):
    points = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    row = regression.with_p_values(regression.with_errors(
        regression.regression_sums(points))).first()
    assert row.slope == 2.0 and row.slope_se is None and row.slope_p is None


def test_constant_variable_has_no_line_and_no_correlation(spark):
    points = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, 5.0)], "x double, y double")
    row = regression.with_p_values(regression.with_errors(
        regression.regression_sums(points))).first()
    assert row.n == 3 and row.slope is None and row.sigma is None and row.slope_p is None
    assert regression.correlation(points).first()[0] is None


def test_hexagons_hold_every_point_at_its_nearest_centre(spark):
    x, y, points = sample_points(spark, 300)
    cells = density2d.hexagon_counts(points, bins=8).collect()
    assert sum(r["count"] for r in cells) == 300
    wx, wy = (x.max() - x.min()) / 8, (y.max() - y.min()) / 8
    centres = np.array([(r.hex_x, r.hex_y) for r in cells])
    scaled = centres / [wx, wy * np.sqrt(3)]
    found = np.zeros(len(cells))
    for a, b in zip(x / wx, y / (wy * np.sqrt(3))):
        d = (scaled[:, 0] - a) ** 2 + 3 * (scaled[:, 1] - b) ** 2
        found[d.argmin()] += 1
    assert np.abs(found - [r["count"] for r in cells]).sum() <= 2


def test_kernel_density_against_direct_sum(spark):
    x, y, points = sample_points(spark, 200)
    rows = density2d.kernel_density(points, n=9).collect()
    h = [density2d.kernel_bandwidth(v.std(ddof=1), *np.quantile(v, [0.25, 0.75]), len(v))
         for v in (x, y)]
    assert len(rows) == 81
    for r in rows:
        k = np.exp(-0.5 * (((r.x - x) / h[0]) ** 2 + ((r.y - y) / h[1]) ** 2))
        assert np.isclose(r.density, k.sum() / (200 * h[0] * h[1] * 2 * np.pi))
    with pytest.raises(ValueError):
        density2d.kernel_bandwidth(1.0, 2.0, 2.0, 10)
