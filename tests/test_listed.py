"""The runtime filter and the plan that reads trees of sampled visits only."""

import random

from pyspark.sql import functions as F

from canopyframe.operators.listed import only_listed
from canopyframe.plans.prepare import analysis_table, analysis_table_from_tables, size_abundance


def test_filter_loses_no_listed_row_and_stops_most_others(spark):
    rows = spark.range(50_000).select((F.col("id") % 977).cast("int").alias("a"),
                                      F.col("id").cast("string").alias("b"), F.col("id"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, -1)], "a int, b string, id long"))
    listed = rows.filter("id % 50 = 0 or id = -1").select("a", "b")
    kept = {r.id for r in only_listed(rows, listed, ["a", "b"]).collect()}
    wanted = {k for k in range(50_000) if k % 50 == 0} | {-1}
    assert wanted <= kept and len(kept) < len(wanted) + 50
    assert only_listed(rows, listed, ["a", "b"]).columns == rows.columns
    assert only_listed(rows, listed.limit(0), ["a"]).count() == 0


def test_columns_of_other_types_are_not_hashed(spark):
    rows = spark.range(100).select(F.col("id").cast("int").alias("a"), F.col("id").alias("b"))
    listed = spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert {r.b for r in only_listed(rows, listed, ["a", "b"]).collect()} == set(range(10))
    assert only_listed(rows, listed, ["a"]).count() == 100


def tables(spark, seed=4):
    draw = random.Random(seed)
    cond, plot, tree, macro = [], [], [], []
    for k in range(60):
        for year in (1999, 2001, 2003, 2006):
            place = (k % 3, 1, k % 5, k)
            for kind in ([1, 3] if k % 20 == 0 and year == 2003 else [draw.choice([1, 1, 2, 3, 0])]):
                plot.append((f"p{k}-{year}-{kind}", year, *place, kind, 1, 1.0 * k, 2.0))
            cond.append((year, *place, 0, 40.0 + k, 0.5, draw.choice([0, 0, 30]), 0, 0))
            for t in range(draw.randint(0, 12)):
                cn = f"t{k}-{year}-{t}"
                tree.append((year, cn, None, "x", draw.choice([1, 1, 1, 2]), 10.0, *place, 1, 100,
                             draw.choice([3.0, 6.0, 9.0, None]), 5, 6.0))
                if draw.random() < 0.1:
                    macro.append((cn,))
    place = "STATECD int, UNITCD int, COUNTYCD int, PLOT int"
    return (
        spark.createDataFrame(cond, f"INVYR int, {place}, STDORGCD int, STDAGE double, "
                              "CONDPROP_UNADJ double, DSTRBCD1 int, DSTRBCD2 int, DSTRBCD3 int"),
        spark.createDataFrame(plot, f"CN string, INVYR int, {place}, KINDCD int, DESIGNCD int, "
                              "LON double, LAT double"),
        spark.createDataFrame(tree, "INVYR int, CN string, PREV_TRE_CN string, PLT_CN string, "
                              f"STATUSCD int, ACTUALHT double, {place}, SUBP int, SPCD int, "
                              "DIA double, SPGRPCD int, TPA_UNADJ double"),
        spark.createDataFrame(macro, "cn string"))


def test_lean_plan_equals_the_plain_one(spark):
    cond, plot, tree, macro = tables(spark)
    for options in ({}, {"replacement": "drop"}, {"number": False}):
        plain = analysis_table(size_abundance(cond, plot, tree, macro), min_trees=2, **options)
        lean = analysis_table_from_tables(cond, plot, tree, macro, min_trees=2, **options)
        assert set(lean.columns) == set(plain.columns)
        rows = [sorted((tuple(r) for r in df.select(sorted(plain.columns)).collect()), key=repr)
                for df in (plain, lean)]
        assert rows[0] == rows[1] and rows[0]


def test_trees_pass_the_filter_before_they_are_shuffled(spark):
    cond, plot, tree, macro = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = analysis_table_from_tables(cond, plot, tree, macro, min_trees=2)
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Read upwards from the trees' scan: the filter comes before the first exchange.
    lines = text.splitlines()
    scan = next(k for k, line in enumerate(lines) if "Scan ExistingRDD" in line and "TPA_UNADJ" in line)
    above = lines[:scan]
    bits = max(k for k, line in enumerate(above) if "getbit" in line)
    assert not any("Exchange hashpartitioning" in line for line in above[bits:scan])
