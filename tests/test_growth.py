"""What leaves a task of the fits grows with plots, not with draws, break candidates or batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import criteria, mixedmodel, pareto
from canopyframe.plans.slopes import full_draw_measurements


@pytest.mark.parametrize("key", ["cast(id as string)", "id", "nullif(concat('p:', id), 'p:3')"])
def test_draws_kept_in_tasks_are_the_drawn_ones(spark, key):
    sums = spark.range(6).select(F.expr(key).alias("PLT_CN"), F.expr("5 + 40 * id").alias("N_Trees"),
                                 F.expr("(3 + 30 * id) * 1D").alias("S"))
    plain = pareto.measured_slopes(pareto.pareto_draws(sums)).toPandas()
    kept = pareto.drawn_slopes(sums).toPandas()
    assert list(kept.columns) == list(plain.columns) and len(kept) == 6
    a, b = (f.sort_values("corrected_slope").reset_index(drop=True) for f in (plain, kept))
    assert a["PLT_CN"].fillna("-").tolist() == b["PLT_CN"].fillna("-").tolist()
    for c in ("corrected_slope", "se_mean", "sd"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-12)


def test_full_draws_are_no_rows(spark):
    trees = spark.range(40).select(F.expr("cast(id % 3 as string)").alias("PLT_CN"),
                                   F.expr("5D + id % 7").alias("DIA"))
    plan = full_draw_measurements(trees)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_u#" not in plan


def test_two_part_moments_are_pooled_from_candidates():
    """Brute force over the whole grid for every number of candidates below a size."""
    draw = np.random.default_rng(4)
    post = draw.random((7, 4, 5)) * (draw.random((7, 1, 1)) < 0.8)
    post /= post.sum()
    below, above = draw.normal(size=(2, 7, 4, 5))
    lo, hi = draw.random((1, 4, 1)), draw.random((1, 1, 5))
    under, over = criteria._by_break(post, below, lo), criteria._by_break(post, above, hi)
    for own in range(8):
        passed = np.arange(7) < own
        wide = passed[:, None, None] & np.ones(post.shape, bool)
        want = criteria._moments(np.where(wide, above, below), np.where(wide, hi, lo), post)
        got = criteria._pooled(post.sum(axis=(1, 2)), *np.where(passed, over, under))
        np.testing.assert_allclose(got, want, rtol=1e-10)


def test_a_task_passes_on_its_cells_once(spark, monkeypatch):
    """However many batches a partition comes in."""
    rows = pd.DataFrame({"FINAL_PLT_ID": [f"p{k // 2:02d}" for k in range(60)], "region": "r",
                         "Actual_Dist": [["a", "b"][k // 2 % 2] for k in range(60)], "error": 0.1,
                         "y": np.sin(np.arange(60)), "x": np.cos(np.arange(60))})
    taken = []

    def noted(self, func, schema, *args, **options):
        taken.append(func)
        return plain(self, func, schema, *args, **options)

    state = mixedmodel.plot_state(spark.createDataFrame(rows), ["x"], "Actual_Dist")
    plain = type(state).mapInPandas
    monkeypatch.setattr(type(state), "mapInPandas", noted)
    mixedmodel.plot_products(state, [0.1, 0.2], [0.3, 0.4, 0.5], ["x"], "Actual_Dist")
    pdf = state.toPandas().sort_values(["FINAL_PLT_ID", "error"])
    frames = list(taken[-1](pdf.iloc[k:k + 7] for k in range(0, len(pdf), 7)))
    whole = pd.concat([f[f["whole"]] for f in frames])
    assert len(whole) == 2 * 3 * 2
    assert whole["n"].sum() == (60 - 4) * 2 * 3
