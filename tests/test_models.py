import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.functions.disturbance import BASE_LEVEL
from canopyframe.operators import mixedmodel, modeldata, spatial
from canopyframe.plans import slope_models
from conftest import as_dict

SLOPES = "PLT_CN string, corrected_slope double, se_mean double, sd double"
ATTRIBUTES = ("PLT_CN string, FINAL_PLT_ID string, STDAGE double, DSTRBCD1 int, MAX_HEIGHT double, "
              "ECODE_NAME string, Time_Since_Dist double")


def base_tables(spark):
    slopes = spark.createDataFrame(
        [(str(i), -1.5, 0.1, 0.5) for i in range(9)] + [("pos", 0.1, 0.1, 0.5),
                                                         ("zero", -1.0, 0.1, 0.0)], SLOPES)
    attributes = spark.createDataFrame([
        ("0", "f0", 50.0, 0, 10.0, "R1", 0.0), ("1", "f1", 900.0, 31, 10.0, "R1", 0.0),
        ("2", "f1", 50.0, 40, 10.0, "R2", 0.0), ("3", "f2", 901.0, 0, 10.0, "R1", 0.0),
        ("4", "f2", 0.0, 0, 10.0, "R1", 0.0), ("5", "f2", 50.0, 32, 10.0, "R1", 0.0),
        ("6", "f2", 50.0, 0, 0.0, "R1", 0.0), ("7", "f2", 50.0, 0, 10.0, "", 0.0),
        ("8", "f3", 50.0, 46, 10.0, None, 5.0), ("pos", "f4", 50.0, 0, 10.0, "R1", 0.0),
        ("zero", "f1", 50.0, 10, 10.0, "R1", 5.0)], ATTRIBUTES)
    return slopes, attributes


def test_model_rows(spark):
    rows = modeldata.model_rows(modeldata.slopes_with_attributes(*base_tables(spark)))
    got = {r.PLT_CN: (r.Disturbance_Type, r.region, r.error) for r in rows.collect()}
    assert got == {"0": ("No Disturbance", "R1", 0.2), "1": ("Ground Fire", "R1", 0.2),
                   "2": ("Animal Damage/Grazing", "R2", 0.2), "zero": ("Insect Damage", "R1", None)}


def test_shared_columns_are_rejected(spark):
    slopes, attributes = base_tables(spark)
    with pytest.raises(ValueError, match="STDAGE"):
        modeldata.slopes_with_attributes(attributes.select("PLT_CN", "STDAGE"), attributes)


def test_treated_controls_and_unknown_treatment(spark):
    rows = spark.createDataFrame([("a", BASE_LEVEL), ("b", BASE_LEVEL), ("c", BASE_LEVEL),
                                  ("d", "Wind"), ("e", "Wind"), ("f", "Wind")],
                                 "PLT_CN string, Disturbance_Type string")
    treatment = spark.createDataFrame([("a", "Yes"), ("b", "No"), ("c", None), ("d", "Yes"),
                                       ("e", None)], "PLT_CN string, Treated string")
    kept = modeldata.without_treated_controls(rows, treatment)
    assert {r.PLT_CN for r in kept.collect()} == {"b", "d", "e"}


def test_triggering_disturbance_keeps_the_first(spark):
    rows = modeldata.model_rows(modeldata.slopes_with_attributes(*base_tables(spark)))
    trigger = modeldata.triggering_disturbance(rows)
    assert as_dict(trigger, "FINAL_PLT_ID", "Actual_Dist") == {"f1": "Ground Fire"}
    followed = modeldata.follow_disturbance(rows, trigger)
    assert {r.PLT_CN for r in followed.collect()} == {"1", "2", "zero"}


def test_derivations(spark):
    visits = spark.createDataFrame([
        ("a", 2001, "No"), ("a", 2003, "Yes"), ("a", 2003, "No"), ("a", 2008, "No"),
        ("b", 2001, "No")], "pltID string, INVYR int, Disturbance string")
    got = {(r.pltID, r.INVYR): r.Time_Since_Dist
           for r in modeldata.time_since_disturbance(visits).collect()}
    assert got == {("a", 2001): None, ("a", 2003): 0, ("a", 2008): 5, ("b", 2001): None}
    heights = spark.createDataFrame([("p", 3.0), ("p", None), ("p", 9.0)],
                                    "PLT_CN string, ACTUALHT double")
    assert as_dict(modeldata.max_height(heights), "PLT_CN", "MAX_HEIGHT") == {"p": 9.0}
    codes = spark.createDataFrame([("p", "00"), ("q", "30"), ("r", "60"), ("s", None)],
                                  "PLT_CN string, TRTCD1 string")
    assert as_dict(modeldata.treated(codes), "PLT_CN", "Treated") == {
        "p": "No", "q": "Yes", "r": None, "s": None}


def edges_frame(spark, pairs):
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs],
                                 "region_a string, region_b string")


def regions_frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "region string")


def test_region_checks(spark):
    edges = edges_frame(spark, [("A", "B"), ("B", "C"), ("D", "E")])
    regions = regions_frame(spark, ["A", "B", "D", "X"])
    assert {(r.region_a, r.region_b) for r in spatial.restrict_edges(edges, regions).collect()} == {
        ("A", "B"), ("B", "A")}
    problems = {(r.problem, r.region) for r in spatial.adjacency_problems(edges, regions).collect()}
    assert problems == {("no neighbour", "D"), ("not in matrix", "X")}
    with pytest.raises(ValueError, match="no neighbour: D"):
        spatial.checked_edges(edges, regions)
    odd = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("A", "A"), ("C", "A"),
                                 ("A", "C")], "region_a string, region_b string")
    found = {(r.problem, r.region) for r in spatial.adjacency_problems(
        odd, regions_frame(spark, ["A", "B", "C"])).collect()}
    assert found == {("self edge", "A"), ("one-way edge", "B")}
    good = spatial.checked_edges(edges, regions_frame(spark, ["A", "B", "C"]))
    assert good.count() == 4
    assert {r.region for r in spatial.common_regions(edges, regions).collect()} == {"A", "B", "D"}


# --- the regressions against dense algebra -------------------------------------------------------

REGIONS = ["R0", "R1", "R2", "R3"]
PAIRS = [("R0", "R1"), ("R1", "R2"), ("R2", "R3"), ("R3", "R0")]
LEVELS = ["No Disturbance", "Fire", "Wind"]


def model_data(n=90, plots=18, seed=13):
    rng = np.random.default_rng(seed)
    plot = rng.integers(0, plots, n)
    region = plot % 4
    level = (plot // 4) % 3
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    error = rng.uniform(0.05, 0.3, n)
    y = (-1 + 0.5 * x1 - 0.3 * x2 + 0.2 * (level == 1) + 0.15 * region
         + rng.normal(0, 0.2, plots)[plot] + rng.normal(0, np.sqrt(0.3 ** 2 + error ** 2)))
    return plot, region, level, x1, x2, error, y


def model_frame(spark, data):
    plot, region, level, x1, x2, error, y = data
    return spark.createDataFrame(
        [(f"f{p}", REGIONS[r], LEVELS[k], float(a), float(b), float(e), float(v))
         for p, r, k, a, b, e, v in zip(plot, region, level, x1, x2, error, y)],
        "FINAL_PLT_ID string, region string, kind string, x1 double, x2 double, error double, "
        "y double")


def dense_design(data):
    _, region, level, x1, x2, error, y = data
    # Dummies in alphabetical order of the non-base levels: Fire, Wind.
    return np.column_stack([np.ones_like(x1), x1, x2, level == 1, level == 2]).astype(float)


def dense_posterior(data, sigma, sd_plot=0.0, spread=None, car=None):
    """Mean and sd of (coefficients, regions) and the log evidence up to a constant."""
    plot, region, _, _, _, error, y = data
    x = dense_design(data)
    v = np.diag(sigma ** 2 + error ** 2)
    v += sd_plot ** 2 * (plot[:, None] == plot[None, :])
    inverse = np.linalg.inv(v)
    prior = np.diag([0.0] + [1 / 25] * 4)
    z = x
    log_prior = 0.0
    if spread is not None:
        adjacency = np.zeros((4, 4))
        for a, b in PAIRS:
            i, j = REGIONS.index(a), REGIONS.index(b)
            adjacency[i, j] = adjacency[j, i] = 1
        q = (np.diag(adjacency.sum(1)) - car * adjacency) / spread ** 2
        z = np.column_stack([x, np.eye(4)[region]])
        prior = np.block([[prior, np.zeros((5, 4))], [np.zeros((4, 5)), q]])
        log_prior = 0.5 * np.linalg.slogdet(q)[1]
    a = z.T @ inverse @ z + prior
    b = z.T @ inverse @ y
    theta = np.linalg.solve(a, b)
    evidence = (0.5 * (np.linalg.slogdet(inverse)[1] - y @ inverse @ y + b @ theta
                       - np.linalg.slogdet(a)[1]) + log_prior)
    return theta, np.sqrt(np.diag(np.linalg.inv(a))), evidence


def values(frame, key):
    return {r[key]: (r["mean"], r["sd"]) for r in frame.collect()}


def test_without_regions_equals_weighted_least_squares(spark):
    data = model_data()
    fit = mixedmodel.fit_region_model(model_frame(spark, data), None, ["x1", "x2"], "kind",
                                      BASE_LEVEL, sigmas=[0.3])
    theta, sd, _ = dense_posterior(data, 0.3)
    got = values(fit.coefficients, "term")
    assert list(got) == ["Intercept", "x1", "x2", "Fire", "Wind"]
    assert np.allclose([m for m, _ in got.values()], theta)
    assert np.allclose([s for _, s in got.values()], sd)
    assert fit.regions.count() == 0


def test_region_and_plot_sums_equal_dense_algebra(spark):
    data = model_data()
    df = model_frame(spark, data)
    edges = [(a, b) for a, b in PAIRS] + [(b, a) for a, b in PAIRS]
    regions = mixedmodel._Region(REGIONS, edges)
    evidences, dense = [], []
    for sd_plot in (0.0, 0.25):
        for sigma in (0.2, 0.4):
            cells = mixedmodel.plot_cross_products(
                df, [sigma], [sd_plot], ["x1", "x2"], "kind").collect()
            assert sum(c.n for c in cells) == len(data[0])
            system = mixedmodel._System(cells, 2, ["Fire", "Wind"], REGIONS, "region", "kind")
            for car, spread in ((0.3, 0.5), (0.9, 0.2)):
                q = regions.precision(car) / spread ** 2
                theta, var = (v[0] for v in system.solve(q[None]))
                want, sd, evidence = dense_posterior(data, sigma, sd_plot, spread, car)
                assert np.allclose(theta, want) and np.allclose(np.sqrt(var), sd)
                own = system.log_evidence(q[None])[0]
                own += 0.5 * (regions.log_det(car) - 2 * 4 * np.log(spread))
                evidences.append(own)
                dense.append(evidence)
    assert np.allclose(np.diff(evidences), np.diff(dense))


def test_plain_sums_equal_plot_sums_without_plot_variance(spark):
    df = model_frame(spark, model_data())
    key = ("sigma", "region", "kind")
    plain = {tuple(r[k] for k in key): r for r in mixedmodel.cross_products(
        df, [0.2, 0.5], ["x1", "x2"], "kind").collect()}
    plot = {tuple(r[k] for k in key): r for r in mixedmodel.plot_cross_products(
        df, [0.2, 0.5], [0.0], ["x1", "x2"], "kind").collect()}
    assert set(plain) == set(plot)
    for k, r in plain.items():
        for name in ("n", "log_det", "m_0_0", "m_1_2", "m_3_3"):
            assert np.isclose(r[name], plot[k][name])


def test_plots_in_two_regions_are_refused(spark):
    df = model_frame(spark, model_data())
    mixed = df.replace("f1", "f0", subset=["FINAL_PLT_ID"])
    found = mixedmodel.plots_in_several_cells(mixed, "FINAL_PLT_ID", "region", "kind").collect()
    assert [r[0] for r in found] == ["f0"]
    with pytest.raises(ValueError, match="more than one region"):
        mixedmodel.fit_region_plot_model(mixed, None, ["x1"], "kind", BASE_LEVEL)


def test_full_fits_recover_parameters(spark):
    data = model_data(n=3000, plots=300, seed=3)
    df = model_frame(spark, data).repartition(4).cache()
    edges = edges_frame(spark, PAIRS)
    fit = mixedmodel.fit_region_plot_model(df, edges, ["x1", "x2"], "kind", BASE_LEVEL,
                                           sigma_points=9)
    got = values(fit.coefficients, "term")
    assert abs(got["x1"][0] - 0.5) < 4 * got["x1"][1] < 0.1
    assert abs(got["x2"][0] + 0.3) < 4 * got["x2"][1]
    spread = values(fit.spread, "name")
    assert abs(spread["sigma"][0] - 0.3) < 0.05 and abs(spread["sd_plot"][0] - 0.2) < 0.1
    regions = values(fit.regions, "region")
    assert regions["R3"][0] - regions["R0"][0] > 0.2
    simple = mixedmodel.fit_region_model(df, edges, ["x1", "x2"], "kind", BASE_LEVEL)
    assert abs(values(simple.coefficients, "term")["x1"][0] - 0.5) < 0.1
    assert values(simple.spread, "name")["sigma"][1] < 0.02
    df.unpersist()


def test_plot_state_is_free_of_sigma_and_shuffled_once(spark):
    """Hot plot: half of the rows and all their errors differ, so it spans partitions."""
    data = model_data(n=600, plots=40, seed=5)
    data[0][:300] = 0
    data[1][:300] = data[2][:300] = 0
    df = model_frame(spark, data)
    state = mixedmodel.plot_state(df, ["x1", "x2"], "kind")
    assert not {"sigma", "sd_plot"} & set(state.columns)
    spans = state.withColumn("_p", F.spark_partition_id()).filter("FINAL_PLT_ID = 'f0'").select(
        "_p").distinct().count()
    assert spans > 1
    got = {(r.sigma, r.sd_plot, r.region, r.kind): r for r in mixedmodel.plot_products(
        state, [0.2, 0.5], [0.0, 0.3], ["x1", "x2"], "kind").collect()}
    plot, region, level, x1, x2, error, y = data
    basis = np.column_stack([np.ones_like(x1), x1, x2, y])
    for (sigma, sd, reg, kind), r in got.items():
        here = (np.array(REGIONS)[region] == reg) & (np.array(LEVELS)[level] == kind)
        total, log_det = np.zeros((4, 4)), 0.0
        for p in np.unique(plot[here]):
            own = here & (plot == p)
            inverse = np.linalg.inv(np.diag(sigma ** 2 + error[own] ** 2) + sd ** 2)
            total += basis[own].T @ inverse @ basis[own]
            log_det += np.linalg.slogdet(inverse)[1]
        assert r.n == here.sum() and np.isclose(r.log_det, log_det)
        for i in range(4):
            for j in range(i, 4):
                assert np.isclose(r[mixedmodel.moment_name(i, j)], total[i, j])
    assert len(got) == 4 * len({(a, b) for a, b in zip(region, level)})


def test_one_plot_alone_and_batches_of_one_row(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        data = model_data(n=12, plots=3, seed=2)
        df = model_frame(spark, data)
        many = mixedmodel.plot_cross_products(df, [0.3], [0.2], ["x1", "x2"], "kind").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    few = mixedmodel.plot_cross_products(df, [0.3], [0.2], ["x1", "x2"], "kind").collect()
    key = lambda r: (r.region, r.kind)
    for a, b in zip(sorted(many, key=key), sorted(few, key=key)):
        assert a.n == b.n and np.allclose(a[4:], b[4:])


def dense_quantiles(axis, mass, probs=(0.025, 0.5, 0.975)):
    cum = np.cumsum(mass) - mass / 2
    return np.exp(np.interp(np.array(probs) * mass.sum(), cum, np.log(axis)))


def test_intervals_equal_dense_integration(spark):
    """All four variance parameters and the coefficients, on a dense grid of dense algebra."""
    data = model_data(n=90, plots=18, seed=13)
    df = model_frame(spark, data).cache()
    fit = mixedmodel.fit_region_plot_model(df, edges_frame(spark, PAIRS), ["x1", "x2"], "kind",
                                           BASE_LEVEL)
    plot, region, _, _, _, error, y = data
    z = np.column_stack([dense_design(data), np.eye(4)[region]])
    axes = {"sigma": np.geomspace(0.12, 0.7, 24), "sd_plot": np.geomspace(0.0008, 0.9, 56),
            "car": np.geomspace(0.002, 2000, 16), "sd_region": np.geomspace(0.01, 40, 64)}
    adjacency = np.zeros((4, 4))
    for a, b in PAIRS:
        i, j = REGIONS.index(a), REGIONS.index(b)
        adjacency[i, j] = adjacency[j, i] = 1
    points = [(o, s) for o in axes["car"] for s in axes["sd_region"]]
    q = np.array([(np.diag(adjacency.sum(1)) - o / (1 + o) * adjacency) / s ** 2 for o, s in points])
    prior = 0.5 * np.linalg.slogdet(q)[1] + np.array([
        mixedmodel._half_t(s) + np.log(s) + np.log(o) - 2 * np.log1p(o) for o, s in points])
    full = np.zeros((len(points), 9, 9))
    full[:, 5:, 5:] = q
    full[:, range(1, 5), range(1, 5)] += 1 / 25
    logs, means, variances = [], [], []
    for sigma in axes["sigma"]:
        for sd in axes["sd_plot"]:
            inverse = np.linalg.inv(np.diag(sigma ** 2 + error ** 2)
                                    + sd ** 2 * (plot[:, None] == plot[None, :]))
            b = z.T @ inverse @ y
            a = z.T @ inverse @ z + full
            cov = np.linalg.inv(a)
            theta = cov @ b
            logs.append(0.5 * (np.linalg.slogdet(inverse)[1] - y @ inverse @ y + theta @ b
                               - np.linalg.slogdet(a)[1]) + prior + mixedmodel._half_normal(sigma)
                        + np.log(sigma) + mixedmodel._half_t(sd) + np.log(sd))
            means.append(theta[:, 1])
            variances.append(cov[:, 1, 1])
    logs = np.array(logs).reshape(24, 56, 16, 64)
    p = np.exp(logs - logs.max())
    p /= p.sum()
    got = {r["name"]: r for r in fit.spread.collect()}
    for k, (name, axis) in enumerate(axes.items()):
        mass = p.sum(axis=tuple(i for i in range(4) if i != k))
        assert mass[0] < 0.004 and mass[-1] < 0.004, name
        want = dense_quantiles(axis, mass)
        shown = axis / (1 + axis) if name == "car" else axis
        mean = mass @ shown
        sd = np.sqrt(mass @ (shown - mean) ** 2)
        assert abs(got[name]["mean"] - mean) < 0.02 * max(sd, mean), name
        if name == "car":
            want = want / (1 + want)
        for q_name, value in zip(("q2_5", "q50", "q97_5"), want):
            assert abs(got[name][q_name] - value) < 0.03 * max(sd, value), (name, q_name)
    weights, means, variances = p.ravel(), np.array(means).ravel(), np.array(variances).ravel()
    mean = weights @ means
    sd = np.sqrt(weights @ (variances + means ** 2) - mean ** 2)
    x1 = {r["term"]: r for r in fit.coefficients.collect()}["x1"]
    assert abs(x1["mean"] - mean) < 0.02 * sd and abs(x1["sd"] / sd - 1) < 0.02
    draw = np.random.default_rng(1)
    sample = draw.choice(len(weights), 200_000, p=weights)
    values_ = means[sample] + np.sqrt(variances[sample]) * draw.standard_normal(200_000)
    for name, prob in mixedmodel.QUANTILES.items():
        assert abs(x1[name] - np.quantile(values_, prob)) < 0.04 * sd
    df.unpersist()


def test_mixture_quantiles_of_one_normal():
    q = mixedmodel.mixture_quantiles(np.ones(1), np.array([[2.0, -1.0]]), np.array([[3.0, 0.5]]),
                                     [0.025, 0.5, 0.975])
    z = 1.959964
    assert np.allclose(q, [[2 - 3 * z, -1 - 0.5 * z], [2, -1], [2 + 3 * z, -1 + 0.5 * z]], atol=1e-4)


def test_plans_end_to_end(spark):
    rng = np.random.default_rng(21)
    slopes, attributes, treatment = [], [], []
    codes = [0, 31, 40, 10]
    for i in range(400):
        plot = i // 2
        age, height = rng.uniform(5, 200), rng.uniform(3, 30)
        slopes.append((str(i), float(-1 - 0.2 * np.log10(age) + rng.normal(0, 0.1)), 0.01, 0.2))
        attributes.append((str(i), f"f{plot}", float(age), codes[plot % 4], float(height),
                           REGIONS[plot % 3], float(5 * (i % 2))))
        treatment.append((str(i), "Yes" if i % 10 == 0 else "No"))
    slopes = spark.createDataFrame(slopes, SLOPES)
    attributes = spark.createDataFrame(attributes, ATTRIBUTES)
    treatment = spark.createDataFrame(treatment, "PLT_CN string, Treated string")
    edges = edges_frame(spark, PAIRS)
    one = slope_models.fit_disturbance_type(
        slope_models.disturbance_type_rows(slopes, attributes, treatment), edges)
    got = values(one.coefficients, "term")
    assert set(got) == {"Intercept", "log_age", "log_height", "Animal Damage/Grazing",
                        "Ground Fire", "Insect Damage"}
    assert abs(got["log_age"][0] + 0.2) < 4 * got["log_age"][1]
    two = slope_models.fit_time_since(slope_models.time_since_rows(slopes, attributes), edges)
    got = values(two.coefficients, "term")
    assert set(got) == {"Intercept", "Time_Since_Dist", "log_age", "log_height", "Ground Fire"}
    assert abs(got["Time_Since_Dist"][0]) < 4 * got["Time_Since_Dist"][1]
