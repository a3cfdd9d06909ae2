import pytest
from pyspark.sql import functions as F

from canopyframe.functions import disturbance as dist
from canopyframe.functions import measures
from canopyframe.functions.keys import plot_key
from canopyframe.operators import panel, prep
from canopyframe.plans.prepare import size_abundance, size_abundance_from_folder
from conftest import as_dict

COND = ("STATECD int, UNITCD int, COUNTYCD int, PLOT int, INVYR int, STDORGCD int, STDAGE double, "
        "CONDPROP_UNADJ double, DSTRBCD1 int, DSTRBCD2 int, DSTRBCD3 int")
PLOT = ("CN string, INVYR int, STATECD int, UNITCD int, COUNTYCD int, PLOT int, KINDCD int, "
        "DESIGNCD int, LON double, LAT double")
TREE = ("INVYR int, CN string, PREV_TRE_CN string, PLT_CN string, STATUSCD int, ACTUALHT double, "
        "STATECD int, UNITCD int, COUNTYCD int, PLOT int, SUBP int, SPCD int, DIA double, "
        "SPGRPCD int, TPA_UNADJ double")
ROWS = ("pltID string, INVYR int, TRE_CN string, KINDCD int, Disturbance string, DIA double, "
        "PLT_CN string")


def cond_row(plot, age, weight, codes=(0, 0, 0), year=2005, origin=0):
    return (1, 1, 1, plot, year, origin, age, weight, *codes)


def test_conditions_null_and_empty_semantics(spark):
    cond = spark.createDataFrame([
        cond_row(1, 10.0, 0.25), cond_row(1, 20.0, 0.75), cond_row(1, None, None, (99, 0, 0)),
        cond_row(2, 10.0, None), cond_row(2, 20.0, 1.0),
        cond_row(3, 10.0, 0.0, (None, None, None)),
        cond_row(4, 10.0, 1.0, (10, None, 22)), cond_row(5, 10.0, 1.0, origin=1),
        cond_row(6, None, 1.0), cond_row(7, 10.0, 1.0, origin=None)], COND)
    rows = {r.pltID: r for r in prep.aggregate_conditions(prep.natural_stands(cond)).collect()}
    assert set(rows) == {f"1_1_1_{p}" for p in (1, 2, 3, 4)}
    assert rows["1_1_1_1"].STDAGE == 17.5 and rows["1_1_1_1"].Disturbance == "No"
    assert rows["1_1_1_2"].STDAGE is None
    assert rows["1_1_1_3"].STDAGE is None and rows["1_1_1_3"].DSTRBCD1 == 0
    assert rows["1_1_1_4"].DisturbSum == 32 and rows["1_1_1_4"].Disturbance == "Yes"


def test_plot_key_spells_missing_parts(spark):
    df = spark.createDataFrame([(1, None, 3, 4)], "STATECD int, UNITCD int, COUNTYCD int, PLOT int")
    assert df.select(plot_key()).first()[0] == "1_NA_3_4"


def test_scalar_expressions(spark):
    df = spark.createDataFrame([("Yes", 1.0), ("No", 0.0), (None, None)], "d string, sd double")
    got = df.select(dist.yes_no_flag(F.col("d")).alias("f"),
                    measures.error_ratio(F.lit(1.0), F.col("sd")).alias("e"),
                    measures.zero_if_missing(F.when(F.col("d") == "No", float("nan"))
                                             .otherwise(F.col("sd"))).alias("z")).collect()
    assert [(r.f, r.e, r.z) for r in got] == [(1, 1.0, 1.0), (0, None, 0.0), (None, None, 0.0)]
    labels = spark.createDataFrame([(c,) for c in (0, 32, 46, 91, 7, None)], "c int").select(
        dist.disturbance_label(F.col("c")))
    assert [r[0] for r in labels.collect()] == [
        "No Disturbance", "Crown Fire", "Animal Damage/Grazing", "Landslides/Earthquakes", None,
        None]
    slopes = spark.createDataFrame([("alpha",), ("alpha_low",), ("tau",)], "v string").select(
        measures.slope_from_exponent(F.col("v"), F.lit(1.5)))
    assert [r[0] for r in slopes.collect()] == [-2.5, -2.5, None]


def tree_row(cn, plot=1, year=2005, status=1, dia=10.0):
    return (year, cn, None, "tree-side", status, 1.0, 1, 1, 1, plot, 1, 1, dia, 1, 1.0)


def plot_row(cn, plot=1, year=2005, kind=1):
    return (cn, year, 1, 1, 1, plot, kind, 1, -70.0, 40.0)


def test_size_abundance(spark):
    cond = spark.createDataFrame([cond_row(1, 10.0, 1.0), cond_row(2, 10.0, 1.0),
                                  cond_row(3, 5.0, 1.0)], COND)
    plot = spark.createDataFrame([
        plot_row("p1"), plot_row("p1b"), plot_row("p2", 2, kind=0), plot_row("p3", 3, kind=None)],
        PLOT)
    # The first two keys are equal once rounded to double.
    tree = spark.createDataFrame([
        tree_row("9007199254740993"), tree_row("9007199254740992"), tree_row("dead", status=2),
        tree_row("t2", plot=2), tree_row("t3", plot=3)], TREE)
    macro = spark.createDataFrame([("9007199254740993",)], "cn string")
    rows = size_abundance(cond, plot, tree, macro).collect()
    assert {(r.TRE_CN, r.PLT_CN) for r in rows} == {
        ("9007199254740992", "p1"), ("9007199254740992", "p1b")}
    assert all(r.pltID == "1_1_1_1" for r in rows)


def test_size_abundance_from_folder(spark, tmp_path):
    (tmp_path / "MA_COND.csv").write_text(
        "STATECD,UNITCD,COUNTYCD,PLOT,INVYR,STDORGCD,STDAGE,CONDPROP_UNADJ,DSTRBCD1,DSTRBCD2,"
        "DSTRBCD3\n25,1,3,7,2005,0,40,1,10,NA,NA\n")
    (tmp_path / "MA_PLOT.csv").write_text(
        "CN,INVYR,STATECD,UNITCD,COUNTYCD,PLOT,KINDCD,DESIGNCD,LON,LAT\n"
        "77,2005,25,1,3,7,1,1,-71.5,42.1\n")
    (tmp_path / "MA_TREE.csv").write_text(
        "INVYR,CN,PREV_TRE_CN,PLT_CN,STATUSCD,ACTUALHT,STATECD,UNITCD,COUNTYCD,PLOT,SUBP,SPCD,DIA,"
        "SPGRPCD,TPA_UNADJ\n2005,1,NA,77,1,12,25,1,3,7,1,12,9.5,3,6.01\n"
        "2005,2,NA,77,2,12,25,1,3,7,1,12,9.5,3,6.01\n")
    rows = size_abundance_from_folder(spark, str(tmp_path)).collect()
    assert [(r.TRE_CN, r.PLT_CN, r.Disturbance, r.DIA) for r in rows] == [("1", "77", "Yes", 9.5)]


def visit_rows(plot, year, trees, kind=1, disturbance="No", dia=10.0):
    return [(plot, year, f"{plot}-{year}-{i}", kind, disturbance, dia, f"{plot}:{year}")
            for i in range(trees)]


def test_measured_and_qualifying(spark):
    rows = visit_rows("a", 2005, 3) + visit_rows("b", 2005, 2) + visit_rows("c", 2000, 5)
    rows += visit_rows("d", 2005, 3, dia=None) + visit_rows("e", 2005, 3, dia=5.0)
    df = panel.measured_trees(spark.createDataFrame(rows, ROWS))
    assert as_dict(panel.group_sizes(df, 3), "pltID", "N_trees") == {"a": 3}
    assert panel.in_qualifying_groups(df, 2).count() == 5


def test_history_flags_and_replacement_modes(spark):
    rows = (visit_rows("a", 2002, 2) + visit_rows("a", 2004, 2, kind=3, disturbance="Yes")
            + visit_rows("a", 2006, 2)
            # Two plot rows of one year with different kinds share the year's answer.
            + visit_rows("b", 2002, 1) + visit_rows("b", 2002, 1, kind=3))
    visits = panel.visit_table(spark.createDataFrame(rows, ROWS))
    kept = panel.mark_disturbance(panel.mark_replacements(visits))
    assert {(r.pltID, r.INVYR): (r.KINDCD1, r.Disturbance) for r in kept.collect()} == {
        ("a", 2002): (False, "No"), ("a", 2004): (True, "Yes"), ("a", 2006): (True, "Yes"),
        ("b", 2002): (True, "No")}
    dropped = panel.mark_replacements(visits, "drop").collect()
    assert [(r.pltID, r.INVYR) for r in dropped] == [("a", 2002)]
    with pytest.raises(ValueError):
        panel.mark_replacements(visits, "other")


def test_sampling_is_stable_and_proportional(spark):
    rows = []
    for i in range(600):
        rows += visit_rows(f"p{i}", 2003, 6) + visit_rows(f"p{i}", 2008, 2)
    df = spark.createDataFrame(rows, ROWS)
    one = as_dict(panel.sample_visits(panel.visit_table(df.coalesce(1))), "pltID", "INVYR")
    many = as_dict(panel.sample_visits(panel.visit_table(df.repartition(64))), "pltID", "INVYR")
    assert one == many and set(one.values()) == {2003, 2008}
    share = sum(y == 2003 for y in one.values()) / len(one)
    assert abs(share - 0.75) < 0.06
    other = as_dict(panel.sample_visits(panel.visit_table(df, "other seed")), "pltID", "INVYR")
    assert other != one


def test_analysis_table_agrees_with_its_steps(spark):
    rows = []
    for i in range(40):
        for year in (2001, 2004, 2009):
            rows += visit_rows(f"p{i:02d}", year, 3 + (i + year) % 4,
                               disturbance="Yes" if (i + year) % 5 == 0 else "No")
    df = spark.createDataFrame(rows, ROWS)
    table = panel.analysis_table(df, min_trees=4)
    visits = panel.visit_table(df).filter("N_trees >= 4")
    chosen = as_dict(panel.sample_visits(visits), "pltID", "INVYR")
    seen = {r.pltID: r.INVYR for r in table.select("pltID", "INVYR").distinct().collect()}
    assert seen == chosen
    numbers = as_dict(table.select("pltID", "Plot_Num").distinct(), "pltID", "Plot_Num")
    assert numbers == {p: i for i, p in enumerate(sorted(numbers), start=1)}
    assert all(r.n == r.N_trees for r in table.groupBy("pltID", "N_trees").agg(
        F.count("*").alias("n")).collect())


def test_history_windows_see_visits_only(spark):
    df = spark.createDataFrame(visit_rows("a", 2005, 3), ROWS)
    plan = panel.analysis_table(df, 1, number=False)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "partial_count" in physical[physical.index("Window"):]
