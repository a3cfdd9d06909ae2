"""Plot histories, sampling, numbering and the mortality pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.operators import mortality, panel
from canopyframe.operators.ranking import first_per_key
from canopyframe.plans import mortality_check
from canopyframe.plans.prepare import analysis_table, analysis_table_from_tables
from canopyframe.queries.registry import query, r6_sql, rounded, sa


def _measured(fx):
    return panel.measured_trees(sa(fx))


def _visits(fx):
    return panel.visit_table(_measured(fx)).filter(F.col("N_trees") >= 10)


def _marked(fx, replacement="keep"):
    return panel.mark_disturbance(panel.mark_replacements(_visits(fx), replacement))


@query("f4_f5_f6_measured_trees", "SELECT TRE_CN, PLT_CN, DIA, INVYR FROM {measured}")
def _(fx):
    return _measured(fx).select("TRE_CN", "PLT_CN", "DIA", "INVYR")


@query("a3_group_sizes", """
    SELECT pltID, INVYR, count(*) AS N_trees FROM {measured}
    GROUP BY pltID, INVYR HAVING count(*) >= 25""")
def _(fx):
    return panel.group_sizes(_measured(fx))


@query("a4_distinct_plots", "SELECT DISTINCT pltID FROM {measured}")
def _(fx):
    return _measured(fx).select("pltID").distinct()


@query("j4_in_qualifying_groups", """
    SELECT TRE_CN, pltID, INVYR, N_trees FROM (
        SELECT *, count(*) OVER (PARTITION BY pltID, INVYR) AS N_trees FROM {measured})
    WHERE N_trees >= 25""")
def _(fx):
    return panel.in_qualifying_groups(_measured(fx)).select("TRE_CN", "pltID", "INVYR", "N_trees")


@query("w1_ever_replaced", "SELECT pltID, INVYR, N_trees, KINDCD1 FROM {flagged}")
def _(fx):
    return panel.mark_replacements(_visits(fx)).select("pltID", "INVYR", "N_trees", "KINDCD1")


@query("f16_drop_replacements", """
    SELECT pltID, INVYR, KINDCD1 FROM {flagged} WHERE NOT KINDCD1""")
def _(fx):
    return panel.mark_replacements(_visits(fx), "drop").select("pltID", "INVYR", "KINDCD1")


@query("w2_ever_disturbed", "SELECT pltID, INVYR, Description, Disturbance FROM {marked}")
def _(fx):
    return _marked(fx).select("pltID", "INVYR", "Description", "Disturbance")


@query("o2_sample_visits", "SELECT pltID, INVYR FROM {sampled}")
def _(fx):
    return panel.sample_visits(_marked(fx))


@query("o2_f11_sample_tree_visits", """
    SELECT pltID, arg_min(INVYR, h) AS INVYR FROM (
        SELECT concat_ws('_', STATECD, UNITCD, COUNTYCD, PLOT) AS pltID, INVYR,
               ('0x' || substr(md5(concat_ws('|', '01282024',
                   concat_ws('_', STATECD, UNITCD, COUNTYCD, PLOT), CN)), 1, 15))::BIGINT AS h
        FROM {fx_tree}) GROUP BY pltID""")
def _(fx):
    from canopyframe.functions.keys import plot_key
    trees = (fx.fx_tree.withColumn("pltID", plot_key()).withColumnRenamed("CN", "TRE_CN")
             .withColumn("KINDCD", F.lit(1)).withColumn("Disturbance", F.lit("No")))
    return panel.sample_visits(panel.visit_table(trees))


@query("j5_trees_of_sampled_visits", """
    SELECT TRE_CN, t.pltID, t.INVYR FROM {measured} t
    JOIN {sampled} s ON t.pltID = s.pltID AND t.INVYR = s.INVYR""")
def _(fx):
    chosen = panel.sample_visits(_marked(fx))
    return _measured(fx).join(chosen, on=["pltID", "INVYR"], how="left_semi").select(
        "TRE_CN", "pltID", "INVYR")


@query("w5_o1_plot_numbers", """
    SELECT pltID, row_number() OVER (ORDER BY pltID) AS Plot_Num
    FROM (SELECT DISTINCT pltID FROM {measured})""")
def _(fx):
    return panel.number_plots(_measured(fx))


@query("j6_analysis_table", f"""
    SELECT TRE_CN, PLT_CN, pltID, INVYR, DIA, N_trees, KINDCD1, Description, Disturbance,
           Plot_Num, {r6_sql('STDAGE')} AS STDAGE FROM {{analysis}}""")
def _(fx):
    table = analysis_table_from_tables(fx.fx_cond, fx.fx_plot, fx.fx_tree, fx.fx_macro, min_trees=10)
    return rounded(table.select("TRE_CN", "PLT_CN", "pltID", "INVYR", "DIA", "N_trees", "KINDCD1",
                                "Description", "Disturbance", "Plot_Num", "STDAGE"), "STDAGE")


# --- mortality -----------------------------------------------------------------------------------

def _single(fx):
    return mortality_check.disturbance_and_mortality(sa(fx), fx.fx_visit_mort)


@query("w3_running_maximum", f"""
    SELECT pltID, YEAR, {r6_sql('Max_Mort')} AS Max_Mort FROM {{running}}""")
def _(fx):
    return rounded(mortality.mortality_history(fx.fx_mort).select("pltID", "YEAR", "Max_Mort"),
                   "Max_Mort")


@query("w4_year_of_maximum", """
    SELECT pltID, YEAR, PLT_CN, Max_Mort_Year, Years_Since_Max_Mort FROM {history}""")
def _(fx):
    return mortality.mortality_history(fx.fx_mort).select(
        "pltID", "YEAR", "PLT_CN", "Max_Mort_Year", "Years_Since_Max_Mort")


@query("a5_first_row_per_visit", """
    SELECT PLT_CN, INVYR, TRE_CN, DIA, SPCD FROM {first_trees}""")
def _(fx):
    return first_per_key(sa(fx), ["PLT_CN"], ["INVYR", "TRE_CN"]).select(
        "PLT_CN", "INVYR", "TRE_CN", "DIA", "SPCD")


@query("j13_visits_with_mortality", """
    SELECT PLT_CN, pltID, INVYR, Max_Mort_Year, Disturbance, Disturbance_Flag
    FROM {mort_visits}""")
def _(fx):
    history = mortality.mortality_history(fx.fx_visit_mort)
    return mortality.visits_with_mortality(mortality.visit_summary(sa(fx)), history).select(
        "PLT_CN", "pltID", "INVYR", "Max_Mort_Year", "Disturbance", "Disturbance_Flag")


@query("a6_a7_j14_j15_single_disturbance", """
    SELECT pltID, PLT_CN, INVYR, Max_Mort_Year, Disturbance_Flag, Year_of_Disturbance
    FROM {single}""")
def _(fx):
    return _single(fx).drop("Max_Mort", "First_Max_Mort_Year")


@query("f15_j16_event_visits", """
    SELECT pltID, PLT_CN, INVYR, Max_Mort_Year, Year_of_Disturbance FROM {event_visits}""")
def _(fx):
    return mortality.matching_event_visits(_single(fx)).select(
        "pltID", "PLT_CN", "INVYR", "Max_Mort_Year", "Year_of_Disturbance")


@query("j17_event_trees", f"""
    SELECT TRE_CN, t.pltID, t.PLT_CN, t.INVYR, Year_of_Disturbance, N_trees, Plot_Num,
           {r6_sql('DIA * 2.54')} AS DIA
    FROM (SELECT *, count(*) OVER (PARTITION BY pltID, INVYR) AS N_trees
          FROM (SELECT t.*, e.Year_of_Disturbance FROM {{sa}} t
                JOIN {{event_visits}} e ON t.INVYR = e.INVYR AND t.PLT_CN = e.PLT_CN
                WHERE t.DIA > 5 AND t.INVYR >= 1999)) t
    JOIN (SELECT pltID, row_number() OVER (ORDER BY pltID) AS Plot_Num FROM (
            SELECT DISTINCT pltID FROM (
                SELECT t.pltID FROM {{sa}} t
                JOIN {{event_visits}} e ON t.INVYR = e.INVYR AND t.PLT_CN = e.PLT_CN
                WHERE t.DIA > 5 AND t.INVYR >= 1999
                GROUP BY t.pltID, t.INVYR HAVING count(*) >= 5))) n ON n.pltID = t.pltID
    WHERE N_trees >= 5""")
def _(fx):
    trees = mortality_check.analysis_trees(sa(fx), fx.fx_visit_mort, min_trees=5,
                                           first_year=1999)
    return rounded(trees.select("TRE_CN", "pltID", "PLT_CN", "INVYR", "Year_of_Disturbance",
                                "N_trees", "Plot_Num", "DIA"), "DIA")


@query("x1_plot_mortality", f"""
    SELECT n.pltID, n.INVYR AS YEAR, n.PLT_CN,
           {r6_sql('100 * sum(CASE WHEN n.STATUSCD = 2 THEN p.TPA_UNADJ ELSE 0 END)'
                   ' / sum(p.TPA_UNADJ)')} AS MORT_PERC
    FROM {{fx_chain}} n JOIN {{fx_chain}} p ON n.PREV_TRE_CN = p.CN
    WHERE p.STATUSCD = 1 GROUP BY n.pltID, n.INVYR, n.PLT_CN""")
def _(fx):
    return rounded(mortality.plot_mortality(fx.fx_chain), "MORT_PERC")
