"""Model rows, design matrix, weighted cross-products and the two slope models."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.functions import disturbance as dist
from canopyframe.operators import mixedmodel, modeldata, prep
from canopyframe.plans import slope_models
from canopyframe.plans.prepare import analysis_table
from canopyframe.queries import fits
from canopyframe.queries.registry import query, r6_sql, rounded, sa
from canopyframe.session import materialize


def _model_rows(fx):
    return modeldata.model_rows(modeldata.slopes_with_attributes(fx.fx_slopes, fx.fx_attributes))


@query("j10_s14_slopes_with_attributes", f"""
    SELECT s.PLT_CN, {r6_sql('corrected_slope')} AS corrected_slope, STDAGE, DSTRBCD1
    FROM {{fx_slopes}} s JOIN {{fx_attributes}} a ON s.PLT_CN = a.PLT_CN""")
def _(fx):
    joined = modeldata.slopes_with_attributes(fx.fx_slopes, fx.fx_attributes)
    return rounded(joined.select("PLT_CN", "corrected_slope", "STDAGE", "DSTRBCD1"),
                   "corrected_slope")


@query("f7_f8_f9_f10_model_rows", f"""
    SELECT PLT_CN, region, Disturbance_Type, STDAGE, {r6_sql('error')} AS error FROM {{model_rows}}""")
def _(fx):
    return rounded(_model_rows(fx).select("PLT_CN", "region", "Disturbance_Type", "STDAGE",
                                          "error"), "error")


@query("j11_p17_without_treated_controls",
       "SELECT PLT_CN, Disturbance_Type, Treated FROM {type_rows}")
def _(fx):
    return modeldata.without_treated_controls(_model_rows(fx), fx.fx_treatment).select(
        "PLT_CN", "Disturbance_Type", "Treated")


@query("p18_log_covariates", f"""
    SELECT PLT_CN, {r6_sql('log_age')} AS log_age, {r6_sql('log_height')} AS log_height
    FROM {{type_rows}}""")
def _(fx):
    rows = slope_models.disturbance_type_rows(fx.fx_slopes, fx.fx_attributes, fx.fx_treatment)
    return rounded(rows.select("PLT_CN", "log_age", "log_height"), "log_age", "log_height")


_LEVELS = dist.levels_after_base(dist.DISTURBANCE_LABELS[c] for c in dist.MODEL_CODES)


@query("m8_design_matrix", f"""
    SELECT PLT_CN, {r6_sql('y')} AS y, {r6_sql('error')} AS error, 1.0E0 AS intercept,
           {r6_sql('log_age')} AS log_age, {r6_sql('log_height')} AS log_height, """ + ", ".join(
    f"CASE WHEN Disturbance_Type = '{lv}' THEN 1.0E0 ELSE 0.0E0 END AS is_{i}"
    for i, lv in enumerate(_LEVELS, start=1)) + " FROM {type_rows}")
def _(fx):
    rows = slope_models.disturbance_type_rows(fx.fx_slopes, fx.fx_attributes, fx.fx_treatment)
    design = modeldata.design_matrix(rows, "Disturbance_Type", _LEVELS, dist.BASE_LEVEL,
                                     ["log_age", "log_height"])
    return rounded(design, "y", "error", "log_age", "log_height")


@query("f14_a5_triggering_disturbance", "SELECT FINAL_PLT_ID, Actual_Dist FROM {trigger_rows}")
def _(fx):
    return modeldata.triggering_disturbance(_model_rows(fx))


@query("j12_follow_disturbance", """
    SELECT PLT_CN, FINAL_PLT_ID, Actual_Dist, Time_Since_Dist FROM {time_rows}""")
def _(fx):
    return slope_models.time_since_rows(fx.fx_slopes, fx.fx_attributes).select(
        "PLT_CN", "FINAL_PLT_ID", "Actual_Dist", "Time_Since_Dist")


_SIGMAS = (0.05, 0.1, 0.2)
_PLOT_SDS = (0.05, 0.3)


def _moment_names(k: int) -> list[str]:
    return [mixedmodel.moment_name(i, j) for i in range(k) for j in range(i, k)]


def _moments_sql(basis: list[str]) -> str:
    return ", ".join(f"sum(w * ({basis[i]}) * ({basis[j]})) AS {mixedmodel.moment_name(i, j)}"
                     for i in range(len(basis)) for j in range(i, len(basis)))


def _weighted_sql(rows: str) -> str:
    grid = ", ".join(f"{s}E0" for s in _SIGMAS)
    return (f"SELECT *, 1 / (sigma * sigma + error * error) AS w "
            f"FROM {{{rows}}}, (SELECT unnest([{grid}]) AS sigma)")


_K9 = _moment_names(4)


@query("m9_cross_products", "SELECT sigma, region, Disturbance_Type, n, "
       + f"{r6_sql('log_det')} AS log_det, " + ", ".join(f"{r6_sql(m)} AS {m}" for m in _K9)
       + " FROM {products}", weighted=_weighted_sql("type_rows"), products=f"""
           SELECT sigma, region, Disturbance_Type, count(*) AS n, sum(ln(w)) AS log_det,
                  {_moments_sql(['1.0E0', 'log_age', 'log_height', 'y'])}
           FROM {{weighted}} GROUP BY sigma, region, Disturbance_Type""")
def _(fx):
    rows = slope_models.disturbance_type_rows(fx.fx_slopes, fx.fx_attributes, fx.fx_treatment)
    sums = mixedmodel.cross_products(rows, _SIGMAS, ["log_age", "log_height"], "Disturbance_Type")
    return rounded(sums, "log_det", *_K9)


_K10 = _moment_names(5)
_CORRECTED = ", ".join(
    f"sum({mixedmodel.moment_name(i, j)} - v / (1 + v * m_0_0) * {mixedmodel.moment_name(0, i)} * "
    f"{mixedmodel.moment_name(0, j)}) AS {mixedmodel.moment_name(i, j)}"
    for i in range(5) for j in range(i, 5))


@query("m10_cross_products", "SELECT sigma, sd_plot, region, Actual_Dist, n, "
       + f"{r6_sql('log_det')} AS log_det, " + ", ".join(f"{r6_sql(m)} AS {m}" for m in _K10)
       + " FROM {products}", weighted=_weighted_sql("time_rows"),
       per_plot=f"""
           SELECT sigma, FINAL_PLT_ID, region, Actual_Dist, count(*) AS n, sum(ln(w)) AS log_det,
                  {_moments_sql(['1.0E0', 'Time_Since_Dist', 'log_age', 'log_height', 'y'])}
           FROM {{weighted}} GROUP BY sigma, FINAL_PLT_ID, region, Actual_Dist""",
       products=f"""
           SELECT sigma, sd_plot, region, Actual_Dist, sum(n)::BIGINT AS n,
                  sum(log_det - ln(1 + v * m_0_0)) AS log_det, {_CORRECTED}
           FROM (SELECT *, sd_plot * sd_plot AS v FROM {{per_plot}},
                 (SELECT unnest([{', '.join(f'{s}E0' for s in _PLOT_SDS)}]) AS sd_plot))
           GROUP BY sigma, sd_plot, region, Actual_Dist""")
def _(fx):
    rows = slope_models.time_since_rows(fx.fx_slopes, fx.fx_attributes)
    sums = mixedmodel.plot_cross_products(rows, _SIGMAS, _PLOT_SDS,
                                          ["Time_Since_Dist", "log_age", "log_height"],
                                          "Actual_Dist")
    return rounded(sums, "log_det", *_K10)


@query("m9_disturbance_type_model")
def _(fx):
    rows = slope_models.disturbance_type_rows(fx.fx_slopes, fx.fx_attributes, fx.fx_treatment)
    return slope_models.fit_disturbance_type(rows, fx.fx_adj).table()


# --- from trees to the regression ----------------------------------------------------------------

def _own_rows(fx):
    trees = materialize(sa(fx))
    conditions = prep.aggregate_conditions(prep.natural_stands(fx.fx_cond))
    plots = prep.plots_with_conditions(prep.annual_plots(fx.fx_plot), conditions)
    regions = fx.nation.select(F.col("n_nationkey").cast("int").alias("STATECD"),
                               F.col("n_name").alias("ECODE_NAME"))
    table = analysis_table(trees, min_trees=10, number=False)
    slopes, attributes = slope_models.own_measurements(trees, plots, regions, table)
    treatment = attributes.select("PLT_CN", F.when(F.col("STDAGE") % 4 == 0, "Yes").otherwise("No")
                                  .alias("Treated"))
    return slope_models.disturbance_type_rows(slopes, attributes, treatment)


_OWN_STEPS = {
    **fits._grid_steps("sums"),
    "own_slopes": """
        SELECT PLT_CN, -(avg(a) + 1) AS corrected_slope,
               stddev_samp(a) / sqrt(count(*)) / nullif(stddev_samp(a), 0) AS error
        FROM (SELECT d.PLT_CN, a FROM (
                SELECT PLT_CN, ('0x' || substr(md5(concat_ws('|', 'draws', PLT_CN, chain, iteration)),
                                1, 13))::BIGINT / 4503599627370496.0E0 AS u
                FROM {sums}, range(1, 5) AS c(chain), range(1, 3001) AS i(iteration)) d
              ASOF JOIN (SELECT PLT_CN, a, cum / total AS share FROM {cumulated}) c
                ON d.PLT_CN = c.PLT_CN AND d.u <= c.share)
        GROUP BY PLT_CN""",
    "own_rows": """
        SELECT s.*, p.STDAGE, p.DSTRBCD1, n_name AS region, h.MAX_HEIGHT
        FROM {own_slopes} s JOIN {plotcond} p USING (PLT_CN)
        JOIN (SELECT PLT_CN, max(ACTUALHT) AS MAX_HEIGHT FROM {sa} GROUP BY PLT_CN) h USING (PLT_CN)
        JOIN nation ON n_nationkey = p.STATECD
        WHERE STDAGE <= 900 AND STDAGE > 0 AND DSTRBCD1 IN (0, 10, 22, 46, 40, 30, 31, 80, 52)
          AND MAX_HEIGHT > 0 AND corrected_slope < 0 AND NOT (DSTRBCD1 = 0 AND STDAGE % 4 = 0)""",
}


@query("m7_j10_own_model_rows", f"""
    SELECT PLT_CN, region, floor(corrected_slope * 1e8 + 0.5) / 1e8 AS y, {r6_sql('error')} AS error,
           {r6_sql('log10(STDAGE)')} AS log_age, {r6_sql('log10(MAX_HEIGHT)')} AS log_height
    FROM {{own_rows}}""", **_OWN_STEPS)
def _(fx):
    """Rows of the disturbance model whose slopes and errors come from this library's draws."""
    rows = _own_rows(fx).select("PLT_CN", "region", (F.floor(F.col("y") * 1e8 + 0.5) / 1e8).alias("y"),
                                "error", "log_age", "log_height")
    return rounded(rows, "error", "log_age", "log_height")


@query("m9_model_of_own_fits")
def _(fx):
    return slope_models.fit_disturbance_type(_own_rows(fx), fx.fx_adj).table()


@query("m10_time_since_model")
def _(fx):
    rows = slope_models.time_since_rows(fx.fx_slopes, fx.fx_attributes)
    return slope_models.fit_time_since(rows, fx.fx_adj).table()


# --- optional derivations ----------------------------------------------------------------------

@query("x4_time_since_disturbance", """
    SELECT pltID, INVYR, INVYR - max(CASE WHEN d THEN INVYR END) OVER (
               PARTITION BY pltID ORDER BY INVYR) AS Time_Since_Dist
    FROM (SELECT pltID, INVYR, bool_or(Disturbance = 'Yes') AS d FROM {sa} GROUP BY pltID, INVYR)
    """)
def _(fx):
    return modeldata.time_since_disturbance(sa(fx))


@query("x5_max_height", """
    SELECT PLT_CN, max(ACTUALHT) AS MAX_HEIGHT FROM {sa} GROUP BY PLT_CN""")
def _(fx):
    return modeldata.max_height(sa(fx))


@query("x6_treated", """
    SELECT PLT_CN, CASE WHEN TRTCD1 = 0 THEN 'No' WHEN TRTCD1 IN (10, 20, 30, 40, 50) THEN 'Yes'
           END AS Treated FROM {fx_treatment}""")
def _(fx):
    return modeldata.treated(fx.fx_treatment).select(F.col("PLT_CN"), "Treated")
