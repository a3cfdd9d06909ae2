"""Plans and results with one plot that holds a third of all trees."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import panel, pareto
from canopyframe.plans.prepare import analysis_table, size_abundance
from canopyframe.plans.slopes import plot_slopes


def physical(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan =="):]


@pytest.fixture(scope="module")
def hot_trees():
    rng = np.random.default_rng(17)
    rows = []
    for i in range(12_000):
        plot = "hot" if i % 3 == 0 else f"p{i % 301}"
        year = 2001 + int(rng.integers(0, 4)) * 3
        rows.append((plot, year, f"t{i}", 3 if (plot, year) == ("hot", 2007) else 1,
                     "Yes" if (len(plot) + year) % 7 == 0 else "No",
                     float(5 + rng.integers(0, 30)), f"{plot}:{year}"))
    return pd.DataFrame(rows, columns=["pltID", "INVYR", "TRE_CN", "KINDCD", "Disturbance", "DIA",
                                       "PLT_CN"])


def brute_analysis(trees, min_trees):
    kept = trees[(trees.DIA > 5) & (trees.INVYR >= 2001)]
    sizes = kept.groupby(["pltID", "INVYR"]).TRE_CN.transform("size")
    kept = kept.assign(N_trees=sizes)[sizes >= min_trees].sort_values(["pltID", "INVYR"])
    ticket = [int(hashlib.md5(f"01282024|{p}|{t}".encode()).hexdigest()[:15], 16)
              for p, t in zip(kept.pltID, kept.TRE_CN)]
    kept = kept.assign(ticket=ticket)
    year = kept.loc[kept.groupby("pltID").ticket.idxmin()].set_index("pltID").INVYR
    history = kept.groupby(["pltID", "INVYR"]).agg(
        replaced=("KINDCD", lambda k: (k == 3).any()),
        disturbed=("Disturbance", lambda d: (d != "No").any())).groupby("pltID").cummax()
    number = {p: i for i, p in enumerate(sorted(year.index), start=1)}
    chosen = kept[kept.INVYR == kept.pltID.map(year)]
    return {r.TRE_CN: (r.INVYR, r.N_trees, bool(history.loc[(r.pltID, r.INVYR)].replaced),
                       "Yes" if history.loc[(r.pltID, r.INVYR)].disturbed else "No",
                       number[r.pltID]) for r in chosen.itertuples()}


def test_hot_plot_through_the_panel(spark, hot_trees):
    table = analysis_table(spark.createDataFrame(hot_trees).repartition(8), min_trees=8)
    got = {r.TRE_CN: (r.INVYR, r.N_trees, r.KINDCD1, r.Disturbance, r.Plot_Num)
           for r in table.collect()}
    want = brute_analysis(hot_trees, 8)
    assert got == want and sum(k in want for k in hot_trees[hot_trees.pltID == "hot"].TRE_CN) > 500


def test_hot_plot_in_the_fits(spark, hot_trees):
    df = spark.createDataFrame(hot_trees).withColumn("PLT_CN", F.col("pltID"))
    fit = {r.PLT_CN: r for r in plot_slopes(df).collect()}
    hot = hot_trees[(hot_trees.pltID == "hot") & (hot_trees.DIA * 2.54 >= 12.7)].DIA * 2.54
    assert fit["hot"].N_Trees == len(hot)
    assert np.isclose(fit["hot"].S, np.log(hot / 12.7).sum())
    bins = pareto.two_part_sums(df.withColumn("DIA", F.col("DIA") * 2.54))
    assert bins.agg(F.max(F.size("bins"))).first()[0] <= 41
    # Tree rows are combined before they are shuffled, and no tree row reaches Python.
    plan = physical(pareto.fit_two_part(bins))
    assert plan.count("MapInPandas") == 1
    assert "partial_sum" in plan[plan.index("MapInPandas"):]


def test_filters_and_columns_reach_the_tree_scan(spark, tmp_path):
    tree = spark.createDataFrame(
        [(2005, "1", None, "v", 1, 9.0, 1, 1, 1, 1, 1, 1, 8.0, 1, 6.0)],
        "INVYR int, CN string, PREV_TRE_CN string, PLT_CN string, STATUSCD int, ACTUALHT double, "
        "STATECD int, UNITCD int, COUNTYCD int, PLOT int, SUBP int, SPCD int, DIA double, "
        "SPGRPCD int, TPA_UNADJ double")
    plot = spark.createDataFrame(
        [("v", 2005, 1, 1, 1, 1, 1, 1, -70.0, 40.0)],
        "CN string, INVYR int, STATECD int, UNITCD int, COUNTYCD int, PLOT int, KINDCD int, "
        "DESIGNCD int, LON double, LAT double")
    cond = spark.createDataFrame(
        [(1, 1, 1, 1, 2005, 0, 40.0, 1.0, 0, 0, 0)],
        "STATECD int, UNITCD int, COUNTYCD int, PLOT int, INVYR int, STDORGCD int, STDAGE double, "
        "CONDPROP_UNADJ double, DSTRBCD1 int, DSTRBCD2 int, DSTRBCD3 int")
    tables = {}
    for name, df in (("tree", tree), ("plot", plot), ("cond", cond)):
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    trees = size_abundance(tables["cond"], tables["plot"], tables["tree"])
    assert panel.measured_trees(trees).count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = physical(panel.group_sizes(panel.measured_trees(trees), 1))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "STATUSCD" in line)
    for pushed in ("EqualTo(STATUSCD,1)", "GreaterThan(DIA,5.0)", "GreaterThanOrEqual(INVYR,2001)"):
        assert pushed in scan, scan
    schema = scan[scan.index("ReadSchema"):]
    assert "ACTUALHT" not in scan[:scan.index("Batched")] and "TPA_UNADJ" not in schema
