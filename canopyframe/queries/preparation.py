"""Scans, unions, projections, filters, joins and aggregates of the preparation stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.functions import disturbance as dist
from canopyframe.functions import measures
from canopyframe.functions.keys import plot_key, text_key
from canopyframe.operators import pareto, prep
from canopyframe.queries.registry import query, r6, r6_sql, rounded, sa
from canopyframe.sources.adjacency import adjacency_edges

_COND_COLUMNS = "pltID, INVYR, DSTRBCD1, DSTRBCD2, DSTRBCD3"
_CONDITIONS_SQL = f"SELECT {_COND_COLUMNS}, {r6_sql('STDAGE')} AS STDAGE FROM {{conditions}}"


def _conditions(fx):
    return prep.aggregate_conditions(prep.natural_stands(fx.fx_cond))


@query("s15_adjacency_unpivot", "SELECT region_a, region_b FROM {fx_adj}")
def _(fx):
    names = [r[0] for r in fx.nation.select("n_name").orderBy("n_name").collect()]
    wide = (fx.fx_adj.groupBy(F.col("region_a").alias("name"))
            .pivot("region_b", names).agg(F.count(F.lit(1))).na.fill(0))
    return adjacency_edges(wide, "name")


@query("u1_union_same_columns", """
    SELECT STATECD, count(*) AS n, sum(INVYR)::BIGINT AS years FROM {fx_cond} GROUP BY STATECD""")
def _(fx):
    low, high = fx.fx_cond.filter("STATECD < 12"), fx.fx_cond.filter("STATECD >= 12")
    both = prep.stacked([low, high])
    return both.groupBy("STATECD").agg(F.count(F.lit(1)).alias("n"), F.sum("INVYR").alias("years"))


@query("u2_union_fill_missing", """
    SELECT CN, CASE WHEN STATECD < 12 THEN KINDCD END AS KINDCD, STATECD FROM {fx_plot}""")
def _(fx):
    low = fx.fx_plot.filter("STATECD < 12").select("CN", "KINDCD", "STATECD")
    high = fx.fx_plot.filter("STATECD >= 12").select("STATECD", "CN")
    return prep.stacked([low, high], fill_missing=True)


@query("p1_p3_select_drop_rename", """
    SELECT CN AS PLT_CN, INVYR, STATECD, KINDCD FROM {fx_plot}""")
def _(fx):
    return (fx.fx_plot.drop("LON", "LAT", "DESIGNCD").withColumnRenamed("CN", "PLT_CN")
            .select("PLT_CN", "INVYR", "STATECD", "KINDCD"))


@query("p4_plot_key", """
    SELECT CN, concat_ws('_', STATECD, UNITCD, COUNTYCD, PLOT) AS pltID,
           concat_ws('_', STATECD, coalesce(nullif(COUNTYCD, 1)::VARCHAR, 'NA')) AS partial
    FROM {fx_tree}""")
def _(fx):
    holes = fx.fx_tree.withColumn("COUNTY", F.nullif("COUNTYCD", F.lit(1)))
    return holes.select("CN", plot_key().alias("pltID"), plot_key("STATECD", "COUNTY")
                        .alias("partial"))


@query("p5_p6_disturbance_flags", """
    SELECT pltID, INVYR, DisturbSum, Disturbance,
           CASE WHEN Disturbance = 'Yes' THEN 1 ELSE 0 END AS Disturbance_Flag FROM {conditions}""")
def _(fx):
    return _conditions(fx).select(
        "pltID", "INVYR", "DisturbSum", "Disturbance",
        dist.yes_no_flag(F.col("Disturbance")).alias("Disturbance_Flag"))


@query("p7_disturbance_label", "SELECT PLT_CN, Disturbance_Type FROM {labelled}")
def _(fx):
    return fx.fx_attributes.select(
        "PLT_CN", dist.disturbance_label(F.col("DSTRBCD1")).alias("Disturbance_Type"))


_LEVELS = dist.levels_after_base(dist.DISTURBANCE_LABELS.values())


@query("p8_dummy_columns", "SELECT PLT_CN, " + ", ".join(
    f"CASE WHEN Disturbance_Type = '{lv}' THEN 1.0E0 ELSE 0.0E0 END AS is_{i}"
    for i, lv in enumerate(_LEVELS, start=1)) + " FROM {labelled}")
def _(fx):
    typed = fx.fx_attributes.select(
        "PLT_CN", dist.disturbance_label(F.col("DSTRBCD1")).alias("Disturbance_Type"))
    return dist.add_dummies(typed, "Disturbance_Type", _LEVELS).drop("Disturbance_Type")


@query("p9_error_ratio",
       f"SELECT PLT_CN, {r6_sql('se_mean / sd')} AS error FROM {{fx_slopes}}")
def _(fx):
    return fx.fx_slopes.select(
        "PLT_CN", r6(measures.error_ratio(F.col("se_mean"), F.col("sd"))).alias("error"))


@query("p10_slope_from_exponent", f"""
    SELECT event_id, CASE WHEN event_type = 'click' THEN {r6_sql('-(value + 1)')} END
           AS corrected_slope FROM events""")
def _(fx):
    named = F.when(F.col("event_type") == "click", "alpha").otherwise("tau")
    return fx.events.select("event_id", r6(measures.slope_from_exponent(
        named, F.col("value"))).alias("corrected_slope"))


@query("p11_inches_to_cm", f"SELECT CN, {r6_sql('DIA * 2.54')} AS DIA FROM {{fx_tree}}")
def _(fx):
    return fx.fx_tree.select("CN", r6(measures.inches_to_cm(F.col("DIA"))).alias("DIA"))


@query("p12_p13_event_years", """
    SELECT PLT_CN, CASE WHEN STATUSCD = 2 THEN INVYR ELSE 0 END AS event_year,
           INVYR - 2000 AS years_since FROM {fx_tree}""")
def _(fx):
    flag = F.when(F.col("STATUSCD") == 2, 1).otherwise(0)
    return fx.fx_tree.select(
        "PLT_CN", measures.event_year(flag, F.col("INVYR")).alias("event_year"),
        measures.years_since(F.col("INVYR"), F.lit(2000)).alias("years_since"))


@query("p14_missing_to_zero",
       f"SELECT pltID, YEAR, {r6_sql('MORT_PERC')} AS MORT_PERC FROM {{filled_mort}}")
def _(fx):
    return fx.fx_mort.select("pltID", "YEAR", r6(measures.zero_if_missing(
        F.col("MORT_PERC"))).alias("MORT_PERC"))


@query("p15_text_keys", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey FROM orders")
def _(fx):
    return fx.orders.select(text_key("o_orderkey"), "o_custkey")


@query("p16_a10_group_size", "SELECT PLT_CN, count(*) AS N_Trees FROM {fx_tree} GROUP BY PLT_CN")
def _(fx):
    return pareto.tree_counts(fx.fx_tree).select("PLT_CN", F.col("N_rows").alias("N_Trees"))


@query("f1_natural_stands", """
    SELECT STATECD, count(*) AS n FROM {fx_cond} WHERE STDORGCD = 0 GROUP BY STATECD""")
def _(fx):
    return prep.natural_stands(fx.fx_cond).groupBy("STATECD").agg(F.count(F.lit(1)).alias("n"))


@query("f2_annual_plots", "SELECT CN, KINDCD FROM {fx_plot} WHERE KINDCD NOT IN (0, 4)")
def _(fx):
    return prep.annual_plots(fx.fx_plot).select("CN", "KINDCD")


@query("f3_live_trees", "SELECT CN FROM {fx_tree} WHERE STATUSCD = 1")
def _(fx):
    return prep.live_trees(fx.fx_tree).select("CN")


@query("f4_drop_missing_age", """
    SELECT STATECD, count(*) AS n FROM {fx_cond} WHERE STDAGE IS NOT NULL GROUP BY STATECD""")
def _(fx):
    return prep.with_known_age(fx.fx_cond).groupBy("STATECD").agg(F.count(F.lit(1)).alias("n"))


@query("a1_weighted_mean", _CONDITIONS_SQL)
def _(fx):
    return rounded(_conditions(fx).drop("DisturbSum", "Disturbance"), "STDAGE")


@query("a2_code_sums", f"SELECT {_COND_COLUMNS} FROM {{conditions}}")
def _(fx):
    return _conditions(fx).select("pltID", "INVYR", "DSTRBCD1", "DSTRBCD2", "DSTRBCD3")


@query("j1_plots_with_conditions", f"""
    SELECT PLT_CN, pltID, INVYR, KINDCD, LON, LAT, {r6_sql('STDAGE')} AS STDAGE, Disturbance
    FROM {{plotcond}}""")
def _(fx):
    joined = prep.plots_with_conditions(prep.annual_plots(fx.fx_plot), _conditions(fx))
    return rounded(joined.select("PLT_CN", "pltID", "INVYR", "KINDCD", "LON", "LAT", "STDAGE",
                                 "Disturbance"), "STDAGE")


@query("j2_without_macroplot_trees", """
    SELECT CN, PLT_CN, DIA FROM {fx_tree} WHERE CN NOT IN (SELECT cn FROM {fx_macro})""")
def _(fx):
    return prep.without_macroplot_trees(fx.fx_tree, fx.fx_macro).select("CN", "PLT_CN", "DIA")


@query("j3_size_abundance", f"""
    SELECT TRE_CN, PLT_CN, pltID, INVYR, DIA, SPCD, TPA_UNADJ, KINDCD, Disturbance,
           {r6_sql('STDAGE')} AS STDAGE FROM {{sa}}""")
def _(fx):
    return rounded(sa(fx).select("TRE_CN", "PLT_CN", "pltID", "INVYR", "DIA", "SPCD", "TPA_UNADJ",
                                 "KINDCD", "Disturbance", "STDAGE"), "STDAGE")
