"""Pareto fits, pointwise likelihood, draws and slope tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.functions.measures import inches_to_cm
from canopyframe.functions.twopart import two_part_log_density
from canopyframe.operators import criteria, pareto
from canopyframe.plans import slopes
from canopyframe.plans.prepare import analysis_table
from canopyframe.queries.registry import query, r6, r6_sql, rounded, sa
from canopyframe.session import materialize


def _trees(fx):
    return analysis_table(sa(fx), min_trees=10, number=False).withColumn(
        "DIA", inches_to_cm(F.col("DIA")))


_GRID = pareto.GRID


def _sums_sql(source: str, weight: str | None = None) -> str:
    total = "sum(ln(x / 12.7)) FILTER (x >= 12.7)"
    if weight:
        total = (f"sum({weight} * ln(x / 12.7)) FILTER (x >= 12.7) / sum({weight}) FILTER (x >= 12.7)"
                 f" * count(*) FILTER (x >= 12.7)")
    return f"""
        SELECT PLT_CN, count(*) FILTER (x >= 12.7) AS n, {total} AS s,
               count(*) FILTER (x < 12.7) AS below
        FROM (SELECT PLT_CN, TPA_UNADJ, DIA * 2.54 AS x FROM {source})
        GROUP BY PLT_CN HAVING count(*) FILTER (x >= 12.7) > 0"""


_STEPS = {
    "sums": _sums_sql("{analysis}"),
    "all_sums": _sums_sql("{sa}"),
    "weighted_sums": _sums_sql("{analysis}", "TPA_UNADJ"),
}


def _grid_steps(sums: str) -> dict[str, str]:
    peak = "least(coalesce(n / nullif(s, 0), 5), 5)"
    return {
        **_STEPS,
        "edges": f"""
            SELECT *, greatest({peak} - 12 * {peak} / sqrt(n), 0) AS lo,
                   least({peak} + 12 * {peak} / sqrt(n) + 40.0E0 * {peak} / n, 5) AS hi
            FROM {{{sums}}}""",
        "cells": f"""
            SELECT PLT_CN, n, s, below, k, a, exp(lw - max(lw) OVER (PARTITION BY PLT_CN)) AS w
            FROM (SELECT PLT_CN, n, s, below, k, a,
                         (n - 1) * ln(a) - a * s - (ln(a) - 1) * (ln(a) - 1) / 2 AS lw
                  FROM (SELECT *, lo + (hi - lo) / {_GRID} * (k - 0.5E0) AS a
                        FROM {{edges}}, range(1, {_GRID} + 1) AS g(k)))""",
        "cumulated": """
            SELECT *, sum(w) OVER (PARTITION BY PLT_CN ORDER BY k) AS cum,
                   sum(w) OVER (PARTITION BY PLT_CN) AS total FROM {cells}""",
        "fit": """
            SELECT PLT_CN, any_value(n) AS N_Trees, any_value(below) AS N_below, any_value(s) AS S,
                   any_value(n) / any_value(s) AS alpha_mle, sum(a * w) / sum(w) AS alpha_mean,
                   sqrt(greatest(sum(a * a * w) / sum(w) - (sum(a * w) / sum(w)) ** 2, 0))
                       AS alpha_sd,
                   min(a) FILTER (cum >= 0.05 * total) AS q5,
                   min(a) FILTER (cum >= 0.5 * total) AS median,
                   min(a) FILTER (cum >= 0.95 * total) AS q95
            FROM {cumulated} GROUP BY PLT_CN""",
    }


_FIT_COLUMNS = ("S", "alpha_mle", "alpha_mean", "alpha_sd", "q5", "median", "q95",
                "corrected_slope")
_FIT_SQL = "SELECT PLT_CN, N_Trees, N_below, " + ", ".join(
    f"{r6_sql(c if c != 'corrected_slope' else '-(alpha_mean + 1)')} AS {c}"
    for c in _FIT_COLUMNS) + " FROM {fit}"


@query("m1_pareto_fit", _FIT_SQL, **_grid_steps("sums"))
def m1(fx):
    return rounded(slopes.plot_slopes(
        analysis_table(sa(fx), min_trees=10, number=False), grid=_GRID), *_FIT_COLUMNS)


@query("m1_pareto_fit_all_visits", _FIT_SQL, **_grid_steps("all_sums"))
def _(fx):
    return rounded(slopes.plot_slopes(sa(fx), grid=_GRID), *_FIT_COLUMNS)


@query("x2_weighted_fit", _FIT_SQL, **_grid_steps("weighted_sums"))
def _(fx):
    return rounded(slopes.plot_slopes(
        analysis_table(sa(fx), min_trees=10, number=False), weight="TPA_UNADJ", grid=_GRID),
        *_FIT_COLUMNS)


def _density_sql(x: str, lo: str, hi: str, tau: str) -> str:
    norm = (f"(-ln({tau} ** ({lo} - {hi}) / {lo} * (12.7E0 ** (-{lo}) - {tau} ** (-{lo}))"
            f" + {tau} ** (-{hi}) / {hi}))")
    return (f"CASE WHEN {x} < {tau} THEN {norm} + ({lo} - {hi}) * ln({tau}) - ({lo} + 1) * ln({x})"
            f" ELSE {norm} - ({hi} + 1) * ln({x}) END")


@query("m2_two_part_log_density", f"""
    SELECT CN, {r6_sql(_density_sql('x', 'lo', 'hi', 'tau'))} AS log_density
    FROM (SELECT CN, 13 + DIA AS x, 1 + SPCD / 50.0E0 AS lo, 2 + SPGRPCD / 4.0E0 AS hi,
                 20.0E0 + SUBP AS tau FROM {{fx_tree}})""")
def _(fx):
    density = two_part_log_density(
        F.col("DIA") + 13, F.col("SPCD") / 50 + 1, F.col("SPGRPCD") / 4 + 2, F.col("SUBP") + 20.0,
        F.lit(12.7))
    return fx.fx_tree.select("CN", r6(density).alias("log_density"))


_T = _A = 10
_LP = """n * (-ln(tau ** (lo - hi) / lo * (12.7E0 ** (-lo) - tau ** (-lo)) + tau ** (-hi) / hi))
                  + n_low * (lo - hi) * ln(tau) - (lo + 1) * s_low - (hi + 1) * s_high
                  - ln(lo) - (ln(lo) - 1) ** 2 / 2 - ln(hi) - (ln(hi) - 1) ** 2 / 2"""


def _cells_sql(a: int, ranges: str) -> str:
    """Every grid cell of every plot with its log weight; ``ranges`` has l0, l1, h0, h1 by plot."""
    return f"""
        SELECT *, {_LP} AS lp
        FROM (SELECT *, l0 + (l1 - l0) * (i - 0.5E0) / {a} AS lo,
                     h0 + (h1 - h0) * (j - 0.5E0) / {a} AS hi
              FROM {{by_tau}} JOIN {ranges} USING (PLT_CN),
                   range(1, {a} + 1) AS gi(i), range(1, {a} + 1) AS gj(j))"""


def _next_sql(name: str, a: int, top: float) -> str:
    """One look at an exponent's range, as ``pareto._next_range``: next ends and whether it is done."""
    r0, r1, m, sd = f"{name}0", f"{name}1", f"{name}_mean", f"{name}_sd"
    step = f"(({r1} - {r0}) / {a})"
    cut = (f"(({name}_first > 1E-3 AND {r0} > {top * 1e-9!r}) OR "
           f"({name}_last > 1E-3 AND {r1} < {top * (1 - 1e-9)!r}))")
    reach = (f"CASE WHEN {cut} THEN {r1} - {r0} "
             f"ELSE greatest({a} * {sd} / 3.3E0, 2 * {step}) END")
    done = f"(NOT {cut} AND {sd} >= 1.5E0 * {step})"
    return (f"{done} AS {name}_done, "
            f"CASE WHEN {done} THEN {r0} ELSE greatest({m} - ({reach}), 0) END AS next_{r0}, "
            f"CASE WHEN {done} THEN {r1} ELSE least({m} + ({reach}), {top}) END AS next_{r1}")


def _two_part_steps(t: int, a: int, resolve: bool = False) -> dict[str, str]:
    """Whole ranges, or the exponents' ranges narrowed by recursion until they resolve the mass.

    The break's range is never narrowed here: no plot of the test tables has enough trees for it.
    """
    whole = "(SELECT DISTINCT PLT_CN, 0.0E0 AS l0, 5.0E0 AS l1, 0.0E0 AS h0, 10.0E0 AS h1 FROM {bins})"
    looks = f"""
        SELECT *, 0 AS turn FROM {whole}
        UNION ALL
        SELECT PLT_CN, next_l0, next_l1, next_h0, next_h1, turn + 1
        FROM (SELECT *, {_next_sql('l', a, 5.0)}, {_next_sql('h', a, 10.0)}
              FROM (SELECT PLT_CN, l0, l1, h0, h1, turn, sum(w * lo) / sum(w) AS l_mean,
                           sqrt(greatest(sum(w * lo * lo) / sum(w) - (sum(w * lo) / sum(w)) ** 2, 0))
                               AS l_sd,
                           coalesce(sum(w) FILTER (i = 1), 0) / sum(w) AS l_first,
                           coalesce(sum(w) FILTER (i = {a}), 0) / sum(w) AS l_last,
                           sum(w * hi) / sum(w) AS h_mean,
                           sqrt(greatest(sum(w * hi * hi) / sum(w) - (sum(w * hi) / sum(w)) ** 2, 0))
                               AS h_sd,
                           coalesce(sum(w) FILTER (j = 1), 0) / sum(w) AS h_first,
                           coalesce(sum(w) FILTER (j = {a}), 0) / sum(w) AS h_last
                    FROM (SELECT *, exp(lp - max(lp) OVER (PARTITION BY PLT_CN)) AS w
                          FROM ({_cells_sql(a, 'looks')}))
                    GROUP BY PLT_CN, l0, l1, h0, h1, turn))
        WHERE NOT (l_done AND h_done)"""
    return {
        "bins": f"""
            SELECT PLT_CN, b, count(*) AS n, sum(ln(x)) AS s
            FROM (SELECT PLT_CN, x, least(greatest(
                      floor((x - 12.7E0) / ((50.0E0 - 12.7E0) / {t}) + 0.5)::INT, 0), {t}) AS b
                  FROM (SELECT PLT_CN, DIA * 2.54 AS x FROM {{analysis}}) WHERE x >= 12.7)
            GROUP BY PLT_CN, b""",
        "by_tau": f"""
            SELECT PLT_CN, t, 12.7E0 + (50.0E0 - 12.7E0) * (t - 0.5E0) / {t} AS tau, sum(n) AS n,
                   coalesce(sum(n) FILTER (b < t), 0) AS n_low,
                   coalesce(sum(s) FILTER (b < t), 0) AS s_low,
                   coalesce(sum(s) FILTER (b >= t), 0) AS s_high
            FROM {{bins}}, range(1, {t} + 1) AS g(t) GROUP BY PLT_CN, t""",
        "looks": looks,
        "ranges": "SELECT PLT_CN, unnest(arg_max({'l0': l0, 'l1': l1, 'h0': h0, 'h1': h1}, turn)) "
                  "FROM {looks} GROUP BY PLT_CN" if resolve else f"SELECT * FROM {whole}",
        "grid3": _cells_sql(a, "{ranges}"),
        "weighed": "SELECT *, exp(lp - max(lp) OVER (PARTITION BY PLT_CN)) AS w FROM {grid3}",
        "marginals": """
            SELECT PLT_CN, n, 'alpha_low' AS variable, i AS cell, any_value(lo) AS v, sum(w) AS w
            FROM {weighed} GROUP BY PLT_CN, n, i
            UNION ALL SELECT PLT_CN, n, 'alpha_high', j, any_value(hi), sum(w)
            FROM {weighed} GROUP BY PLT_CN, n, j
            UNION ALL SELECT PLT_CN, n, 'tau', t, any_value(tau), sum(w)
            FROM {weighed} GROUP BY PLT_CN, n, t""",
        "two_part": """
            SELECT PLT_CN, variable, n::BIGINT AS N_Trees, sum(v * w) / sum(w) AS mean,
                   sqrt(sum(w * (v - m) ** 2) / sum(w)) AS sd
            FROM (SELECT *, sum(v * w) OVER (PARTITION BY PLT_CN, variable)
                            / sum(w) OVER (PARTITION BY PLT_CN, variable) AS m FROM {marginals})
            GROUP BY PLT_CN, variable, n""",
    }


_TWO_PART_STEPS = _two_part_steps(_T, _A)
_RESOLVED_STEPS = _two_part_steps(40, 40, resolve=True)


def _two_part(fx):
    return slopes.two_part_slopes(analysis_table(sa(fx), min_trees=10, number=False), taus=_T,
                                  alphas=_A, resolve=False)


_TWO_PART_SQL = f"""
    SELECT PLT_CN, variable, N_Trees, {r6_sql('mean')} AS mean, {r6_sql('sd')} AS sd,
           CASE WHEN variable <> 'tau' THEN {r6_sql('-(mean + 1)')} END AS corrected_slope
    FROM {{two_part}}"""


def _rounded_fit(fitted):
    return rounded(fitted.select("PLT_CN", "variable", "N_Trees", "mean", "sd", "corrected_slope"),
                   "mean", "sd", "corrected_slope")


@query("m3_two_part_fit", _TWO_PART_SQL, **_TWO_PART_STEPS)
def _(fx):
    return _rounded_fit(_two_part(fx))


@query("m3_two_part_fit_fine_grid", _TWO_PART_SQL, recursive=True, **_RESOLVED_STEPS)
def _(fx):
    return _rounded_fit(slopes.two_part_slopes(analysis_table(sa(fx), min_trees=10, number=False)))


@query("m4_pointwise_log_likelihood", f"""
    SELECT TRE_CN, PLT_CN, {r6_sql(_density_sql('x', 'lo', 'hi', 'tau'))} AS log_lik
    FROM (SELECT TRE_CN, PLT_CN, DIA * 2.54 AS x FROM {{analysis}})
    JOIN (SELECT PLT_CN, max(mean) FILTER (variable = 'alpha_low') AS lo,
                 max(mean) FILTER (variable = 'alpha_high') AS hi,
                 max(mean) FILTER (variable = 'tau') AS tau
          FROM {{two_part}} GROUP BY PLT_CN) USING (PLT_CN)
    WHERE x >= 12.7""", **_TWO_PART_STEPS)
def _(fx):
    parameters = pareto.two_part_parameters(_two_part(fx))
    scored = pareto.pointwise_log_likelihood(_trees(fx), parameters)
    return rounded(scored.select("TRE_CN", "PLT_CN", "log_lik"), "log_lik")


_ITERATIONS = ", ".join(str(i) for i in pareto.thinned_iterations())
_DRAWS = f"""
    SELECT PLT_CN, chain, iteration, min(a) AS value
    FROM {{cumulated}} JOIN (
        SELECT PLT_CN, chain::INT AS chain, iteration,
               ('0x' || substr(md5(concat_ws('|', 'draws', PLT_CN, chain, iteration)), 1, 13))
                   ::BIGINT / 4503599627370496.0E0 AS u
        FROM {{sums}}, range(1, 5) AS c(chain),
             (SELECT unnest([{_ITERATIONS}]) AS iteration)) USING (PLT_CN)
    WHERE cum >= u * total GROUP BY PLT_CN, chain, iteration"""


def _draws(fx):
    return pareto.pareto_draws(pareto.pareto_sums(_trees(fx)),
                               iterations=pareto.thinned_iterations(), grid=_GRID)


@query("m5_posterior_draws", f"""
    SELECT PLT_CN, 'alpha' AS variable, chain, iteration, {r6_sql('value')} AS value
    FROM {{draws}}""", draws=_DRAWS, **_grid_steps("sums"))
def _(fx):
    return rounded(_draws(fx), "value")


_SUMMARY_COLUMNS = ("mean", "median", "sd", "mad", "q5", "q95")


def _summary_sql(value: str = "value", mad_digits: int = 6) -> str:
    mad = f"(floor(1.4826 * mad({value}) * 1e{mad_digits} + 0.5) / 1e{mad_digits})"
    return (f"{r6_sql(f'avg({value})')} AS mean, {r6_sql(f'median({value})')} AS median, "
            f"{r6_sql(f'stddev_samp({value})')} AS sd, {mad} AS mad, "
            f"{r6_sql(f'quantile_cont({value}, 0.05)')} AS q5, "
            f"{r6_sql(f'quantile_cont({value}, 0.95)')} AS q95")


@query("m6_m7_u3_thinned_slopes", f"""
    SELECT d.PLT_CN, 'alpha' AS variable, iteration, {_summary_sql()}, 1 AS multbayesnumber,
           any_value(n) AS N_Trees, {r6_sql('-(avg(value) + 1)')} AS corrected_slope
    FROM {{draws}} d JOIN {{sums}} s ON d.PLT_CN = s.PLT_CN GROUP BY d.PLT_CN, iteration""",
       draws=_DRAWS, **_grid_steps("sums"))
def _(fx):
    table = slopes.thinned_slopes(analysis_table(sa(fx), min_trees=10, number=False),
                                  two_part=False, grid=_GRID)
    return rounded(table, *_SUMMARY_COLUMNS, "corrected_slope")


def _level_sql(source: str, keys: str, at: str, columns: str = "") -> str:
    """Cumulated weights of one level of the grid inside the levels above it."""
    return f"""
        SELECT {keys}, {at}, w, {columns} sum(w) OVER (PARTITION BY {keys} ORDER BY {at}) AS cum,
               sum(w) OVER (PARTITION BY {keys}) AS total FROM {source}"""


# A draw finds its cell level by level: break, lower exponent, upper exponent.
_DRAWN = {
    "by_t": _level_sql("(SELECT PLT_CN, t, sum(w) AS w FROM {weighed} GROUP BY ALL)", "PLT_CN", "t"),
    "by_i": _level_sql("(SELECT PLT_CN, t, i, sum(w) AS w FROM {weighed} GROUP BY ALL)",
                       "PLT_CN, t", "i"),
    "picked_t": f"""
        SELECT d.PLT_CN, chain, iteration, c.t, u * total - (cum - w) AS rest
        FROM (SELECT PLT_CN, chain::INT AS chain, iteration, total,
                     ('0x' || substr(md5(concat_ws('|', 'draws', PLT_CN, chain, iteration)), 1, 13))
                         ::BIGINT / 4503599627370496.0E0 AS u
              FROM (SELECT DISTINCT PLT_CN, total FROM {{by_t}}), range(1, 5) AS c(chain),
                   (SELECT unnest([{_ITERATIONS}]) AS iteration)) d
        ASOF JOIN (SELECT PLT_CN, t, w, cum FROM {{by_t}}) c
          ON d.PLT_CN = c.PLT_CN AND d.u * d.total <= c.cum""",
    "picked_i": """
        SELECT d.PLT_CN, chain, iteration, d.t, c.i, rest - (cum - w) AS rest
        FROM (SELECT p.*, least(rest, top) AS v FROM {picked_t} p
              JOIN (SELECT PLT_CN, t, max(cum) AS top FROM {by_i} GROUP BY ALL) USING (PLT_CN, t)) d
        ASOF JOIN {by_i} c ON d.PLT_CN = c.PLT_CN AND d.t = c.t AND d.v <= c.cum""",
    "by_j": _level_sql("(SELECT * FROM {weighed} SEMI JOIN {picked_i} USING (PLT_CN, t, i))",
                       "PLT_CN, t, i", "j", "lo, hi, tau,"),
    "picked": """
        SELECT d.PLT_CN, chain, iteration, lo, hi, tau
        FROM (SELECT p.*, least(rest, top) AS v FROM {picked_i} p
              JOIN (SELECT PLT_CN, t, i, max(cum) AS top FROM {by_j} GROUP BY ALL)
              USING (PLT_CN, t, i)) d
        ASOF JOIN {by_j} c
          ON d.PLT_CN = c.PLT_CN AND d.t = c.t AND d.i = c.i AND d.v <= c.cum""",
    "two_part_draws": """
        SELECT PLT_CN, unnest(['alpha_low', 'alpha_high', 'tau']) AS variable, chain, iteration,
               unnest([lo, hi, tau]) AS value FROM {picked}""",
}
_TWO_PART_DRAWS = {**_TWO_PART_STEPS, **_DRAWN}
_RESOLVED_DRAWS = {**_RESOLVED_STEPS, **_DRAWN}


@query("m5_two_part_draws", f"""
    SELECT PLT_CN, variable, chain, iteration, {r6_sql('value')} AS value
    FROM {{two_part_draws}}""", **_TWO_PART_DRAWS)
def _(fx):
    sums = pareto.two_part_sums(_trees(fx), taus=_T)
    draws = pareto.two_part_draws(sums, iterations=pareto.thinned_iterations(), taus=_T,
                                  alphas=_A)
    return rounded(draws, "value")


@query("m6_two_part_thinned_slopes", f"""
    SELECT d.PLT_CN, variable, iteration, {_summary_sql(mad_digits=4)}, 1 AS multbayesnumber,
           any_value(n)::BIGINT AS N_Trees,
           CASE WHEN variable <> 'tau' THEN {r6_sql('-(avg(value) + 1)')} END AS corrected_slope
    FROM {{two_part_draws}} d JOIN {{all_bins}} s ON d.PLT_CN = s.PLT_CN
    GROUP BY d.PLT_CN, variable, iteration""", recursive=True, **_RESOLVED_DRAWS,
       all_bins="SELECT PLT_CN, sum(n) AS n FROM {bins} GROUP BY PLT_CN")
def _(fx):
    table = slopes.thinned_slopes(analysis_table(sa(fx), min_trees=10, number=False))
    # Breaks lie on a grid, where 1.4826 mad is often half of a sixth decimal.
    return rounded(table.withColumn("mad", F.floor(F.col("mad") * 1e4 + 0.5) / 1e4),
                   *(c for c in _SUMMARY_COLUMNS if c != "mad"), "corrected_slope")


@query("m6_weighted_thinned_slopes", f"""
    SELECT d.PLT_CN, 'alpha' AS variable, iteration, {_summary_sql()}, 1 AS multbayesnumber,
           any_value(n) AS N_Trees, {r6_sql('-(avg(value) + 1)')} AS corrected_slope
    FROM {{draws}} d JOIN {{sums}} s ON d.PLT_CN = s.PLT_CN GROUP BY d.PLT_CN, iteration""",
       draws=_DRAWS, **{**_grid_steps("sums"), "sums": _STEPS["weighted_sums"]})
def _(fx):
    table = slopes.thinned_slopes(analysis_table(sa(fx), min_trees=10, number=False),
                                  weight="TPA_UNADJ", two_part=False, grid=_GRID)
    return rounded(table, *_SUMMARY_COLUMNS, "corrected_slope")


@query("m7_measured_slopes", f"""
    SELECT PLT_CN, floor(-(avg(a) + 1) * 1e8 + 0.5) / 1e8 AS corrected_slope,
           {r6_sql('stddev_samp(a) / sqrt(count(*))')} AS se_mean, {r6_sql('stddev_samp(a)')} AS sd,
           any_value(n) AS N_Trees
    FROM (SELECT d.PLT_CN, a, n FROM (
            SELECT PLT_CN, ('0x' || substr(md5(concat_ws('|', 'draws', PLT_CN, chain, iteration)),
                            1, 13))::BIGINT / 4503599627370496.0E0 AS u
            FROM {{sums}}, range(1, 5) AS c(chain), range(1, 3001) AS i(iteration)) d
          ASOF JOIN (SELECT PLT_CN, n, a, cum / total AS share FROM {{cumulated}}) c
            ON d.PLT_CN = c.PLT_CN AND d.u <= c.share)
    GROUP BY PLT_CN""", **_grid_steps("sums"))
def _(fx):
    """All 12,000 draws of every plot."""
    measured = slopes.full_draw_measurements(
        analysis_table(sa(fx), min_trees=10, number=False), grid=_GRID)
    # Means of values on a grid are often half of a sixth decimal.
    slope = F.floor(F.col("corrected_slope") * 1e8 + 0.5) / 1e8
    return rounded(measured, "se_mean", "sd").withColumn("corrected_slope", slope)


# --- left-out rows, information criteria ---------------------------------------------------------

@query("m1_tree_counts", """
    SELECT PLT_CN, count(*) AS N_rows, count(*) FILTER (x IS NULL OR TPA_UNADJ IS NULL) AS N_missing,
           count(*) FILTER (x < 12.7 AND TPA_UNADJ IS NOT NULL) AS N_below,
           count(*) FILTER (x >= 12.7 AND TPA_UNADJ IS NOT NULL) AS N_Trees,
           count(*) FILTER (x >= 12.7 AND TPA_UNADJ IS NOT NULL) > 0 AS fitted
    FROM (SELECT PLT_CN, TPA_UNADJ, DIA * 2.54 AS x FROM {sa}) GROUP BY PLT_CN""")
def _(fx):
    trees = sa(fx).withColumn("DIA", inches_to_cm(F.col("DIA")))
    return pareto.tree_counts(trees, weight="TPA_UNADJ")


_CRITERIA = ("lppd", "p_waic", "elpd", "waic", "se")
# Per tree: log mean density and variance of the log density over the grid, by brute force.
_WAIC_SQL = f"""
    SELECT PLT_CN, count(*) AS N_Trees, {r6_sql('sum(lppd)')} AS lppd, {r6_sql('sum(v)')} AS p_waic,
           {r6_sql('sum(lppd - v)')} AS elpd, {r6_sql('-2 * sum(lppd - v)')} AS waic,
           {r6_sql('sqrt(count(*) * var_samp(lppd - v))')} AS se
    FROM (SELECT PLT_CN, TRE_CN, ln(sum(w * exp(d)) / sum(w)) AS lppd,
                 sum(w * d * d) / sum(w) - (sum(w * d) / sum(w)) ** 2 AS v
          FROM {{pointwise}} GROUP BY PLT_CN, TRE_CN) GROUP BY PLT_CN"""
_SIZES_SQL = "(SELECT PLT_CN, TRE_CN, DIA * 2.54 AS x FROM {analysis} WHERE DIA * 2.54 >= 12.7)"


@query("m4_one_part_criteria", _WAIC_SQL, **_grid_steps("sums"), pointwise=f"""
    SELECT PLT_CN, TRE_CN, w, ln(a) + a * ln(12.7E0) - (a + 1) * ln(x) AS d
    FROM {{cells}} JOIN {_SIZES_SQL} USING (PLT_CN)""")
def _(fx):
    return rounded(criteria.one_part_criteria(_trees(fx), grid=_GRID), *_CRITERIA)


@query("m4_two_part_criteria", _WAIC_SQL, **_TWO_PART_STEPS, pointwise=f"""
    SELECT PLT_CN, TRE_CN, w, {_density_sql('x', 'lo', 'hi', 'tau')} AS d
    FROM {{weighed}} JOIN {_SIZES_SQL} USING (PLT_CN)""")
def _(fx):
    trees = _trees(fx)
    found = criteria.two_part_criteria(trees, pareto.two_part_sums(trees, taus=_T), taus=_T, alphas=_A)
    return rounded(found, *_CRITERIA)


@query("m4_compared_fits")
def _(fx):
    """Both fits at the library's own grids, side by side."""
    # Written: the sums, the passes over open breaks and the cells of both fits read them.
    trees = materialize(_trees(fx).select("PLT_CN", "DIA"))
    two = criteria.two_part_criteria(trees, pareto.resolved_sums(trees))
    return rounded(criteria.compared(criteria.one_part_criteria(trees), two), "elpd_one", "waic_one",
                   "elpd_two", "waic_two", "elpd_gain")


@query("a9_w6_draw_summaries", f"""
    SELECT PLT_CN, variable, iteration, {_summary_sql()}, 1 AS multbayesnumber
    FROM {{fx_draws}} GROUP BY PLT_CN, variable, iteration""")
def _(fx):
    return rounded(pareto.draw_summaries(fx.fx_draws), *_SUMMARY_COLUMNS)


@query("f12_keep_draws", """
    SELECT PLT_CN, variable, chain, iteration, value FROM {fx_draws}
    WHERE iteration IN (1, 4, 7) AND variable IN ('click', 'view')""")
def _(fx):
    return pareto.keep_draws(fx.fx_draws, [1, 4, 7], ["click", "view"])
