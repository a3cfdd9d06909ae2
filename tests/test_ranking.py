import random

import numpy as np
from pyspark.sql import functions as F

from canopyframe.operators import ranking
from conftest import as_dict


def test_numbers_follow_key_order_across_partitions(spark):
    keys = [f"k{random.Random(i).random():.12f}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys + keys[:500]], "k string").repartition(16)
    numbers = as_dict(ranking.number_distinct(df, "k", "n"), "k", "n")
    assert numbers == {k: i for i, k in enumerate(sorted(set(keys)), start=1)}


def test_range_quantiles_equal_numpy_with_one_hot_key(spark):
    rng = np.random.default_rng(3)
    values = {"hot": rng.normal(size=4000), "ties": np.repeat([1.0, 2.0, 7.0], 50),
              "one": np.array([4.5]), "two": np.array([1.0, 3.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: r for r in ranking.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, p in probs.items():
            assert np.isclose(got[k][name], np.quantile(vs, p)), (k, name)
    whole = ranking.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert np.isclose(whole.m, np.median(np.concatenate(list(values.values()))))


def test_group_summaries_agree_on_both_paths(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 7}", float(v)) for i, v in enumerate(rng.normal(size=900))] + [("one", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    small = {r.g: r for r in ranking.summarise_groups(df, ["g"], "v", fixed_size=900).collect()}
    large = {r.g: r for r in ranking.summarise_groups(df, ["g"], "v").collect()}
    assert set(small) == set(large)
    for g, a in small.items():
        for name in ("mean", "median", "sd", "mad", "q5", "q95"):
            b = large[g][name]
            assert (a[name] is None and b is None) or np.isclose(a[name], b)
    vs = np.array([v for g, v in rows if g == "g0"])
    assert np.isclose(small["g0"].mad, 1.4826 * np.median(np.abs(vs - np.median(vs))))
    assert small["one"].sd is None and small["one"].mad == 0.0


def hot_rows(spark):
    """One key holds most rows; its values are spread over twelve decades, tied and negative."""
    rng = np.random.default_rng(9)
    values = {"hot": np.r_[10.0 ** rng.uniform(-6, 6, 3000), -(10.0 ** rng.uniform(-3, 3, 1500)),
                           np.repeat(5.0, 700), np.zeros(300)],
              "flat": np.repeat(2.0, 900), "small": rng.normal(size=40), "one": np.array([1.5])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    rows += [(None, float(v)) for v in range(800)]
    values[None] = np.arange(800.0)
    return values, spark.createDataFrame(rows, "k string, v double").repartition(8)


def test_counting_passes_equal_numpy_for_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_GROUP", 500)
    values, df = hot_rows(spark)
    small, large = ranking._split(df, ["k"], "v")
    assert {r.k for r in large.select("k").distinct().collect()} == {"hot", "flat", None}
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    got = {r.k: r for r in ranking.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, p in probs.items():
            assert np.isclose(got[k][name], np.quantile(vs, p), rtol=1e-12, atol=0), (k, name)
    whole = ranking.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == np.median(np.concatenate(list(values.values())))
    summaries = {r.k: r for r in ranking.summarise_groups(df, ["k"], "v").collect()}
    for k, vs in values.items():
        mad = 1.4826 * np.median(np.abs(vs - np.median(vs)))
        assert np.isclose(summaries[k].mad, mad) and np.isclose(summaries[k].q95, np.quantile(vs, 0.95))


def test_counting_shuffles_no_rows(spark, monkeypatch):
    """Neither a range exchange nor more than one row per cell and task."""
    monkeypatch.setattr(ranking, "SMALL_GROUP", 500)
    _, df = hot_rows(spark)
    sorts = []
    monkeypatch.setattr(ranking, "_range_sorted", lambda *a: sorts.append(a))
    ranking.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()
    assert not sorts


def test_values_that_cannot_be_counted_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_GROUP", 5)
    vs = [1e-300, 1.0, 1e300, float("inf"), -float("inf"), 2.0, 3.0, 0.0, 5e-324, 7.0]
    df = spark.createDataFrame([(1, v) for v in vs], "k int, v double")
    row = ranking.exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.25}).first()
    assert row.m == np.quantile(vs, 0.5) and row.q == np.quantile(vs, 0.25)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert ranking.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect() == []
    assert ranking.exact_quantiles(df, [], "v", {"m": 0.5}).first().m is None


def test_first_per_key_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = ranking.first_per_key(df, ["k"], [F.col("v").desc()])
    assert as_dict(out, "k", "v") == {0: 999, 1: 997, 2: 998}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_a_hot_plot_is_split_by_the_join(spark):
    """Half of all rows on one key: the final plan reads its partition in slices."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        trees = spark.range(200_000, numPartitions=8).select(
            F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000).alias("PLOT"),
            F.sha2(F.col("id").cast("string"), 256).alias("CN"))
        plots = spark.range(5000).select(F.col("id").alias("PLOT"), F.lit(1).alias("KINDCD"))
        joined = trees.join(plots, "PLOT", "inner")
        joined.write.format("noop").mode("overwrite").save()
        assert joined.count() == 200_000
        rows = joined.select("CN").distinct()
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
