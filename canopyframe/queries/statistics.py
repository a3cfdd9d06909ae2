"""Regression, correlation and two-dimensional counts and densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.operators import density2d, mortality, regression
from canopyframe.operators.ranking import exact_quantiles
from canopyframe.plans import mortality_check
from canopyframe.queries.registry import query, r6_sql, rounded, sa


def _points(fx):
    return regression.complete_points(fx.fx_tree, "DIA", "ACTUALHT")


_LINE = """
    SELECT *, my - slope * mx AS intercept,
           CASE WHEN slope IS NOT NULL
                THEN sqrt(greatest(syy - slope * sxy, 0) / nullif(dof, 0)) END AS sigma,
           sxy * sxy / nullif(sxx * syy, 0) AS r2
    FROM (SELECT *, sxy / nullif(sxx, 0) AS slope, n - 2 AS dof
          FROM (SELECT regr_count(y, x)::BIGINT AS n, regr_avgx(y, x) AS mx, regr_avgy(y, x) AS my,
                       regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
                FROM {points}))"""
_LINE_COLUMNS = {
    "slope": "slope", "intercept": "intercept", "sigma": "sigma", "r_squared": "r2",
    "adj_r_squared": "1 - (1 - r2) * (n - 1) / nullif(dof, 0)",
    "slope_se": "sigma / nullif(sqrt(sxx), 0)",
    "intercept_se": "sigma * sqrt(1.0E0 / n + mx * mx / nullif(sxx, 0))",
    "slope_t": "slope / nullif(sigma / nullif(sqrt(sxx), 0), 0)",
    "intercept_t":
        "intercept / nullif(sigma * sqrt(1.0E0 / n + mx * mx / nullif(sxx, 0)), 0)",
    "f_statistic": "(slope / nullif(sigma / nullif(sqrt(sxx), 0), 0)) ** 2",
}


def _line_sql() -> str:
    return "SELECT n, dof, " + ", ".join(
        f"{r6_sql(e)} AS {c}" for c, e in _LINE_COLUMNS.items()) + " FROM {line}"


def _line(points):
    summary = regression.with_errors(regression.regression_sums(points))
    return rounded(summary.select("n", "dof", *_LINE_COLUMNS), *_LINE_COLUMNS)


@query("a11_linear_regression", _line_sql(), line=_LINE)
def _(fx):
    return _line(_points(fx))


_EVENT_POINTS = "SELECT Year_of_Disturbance AS x, Max_Mort_Year AS y FROM {first_single}"


def _event_points(fx):
    single = mortality_check.disturbance_and_mortality(sa(fx), fx.fx_visit_mort)
    return regression.complete_points(mortality.one_row_per_plot(single), "Year_of_Disturbance",
                                      "Max_Mort_Year")


@query("a11_mortality_year_regression", _line_sql().replace("{line}", "{event_line}"),
       event_points=_EVENT_POINTS, event_line=_LINE.replace("{points}", "{event_points}"))
def _(fx):
    return _line(_event_points(fx))


@query("a11_residual_quartiles", "SELECT " + ", ".join(
    f"{r6_sql(f'quantile_cont(r, {p})')} AS {n}" for n, p in (
        ("res_min", 0), ("res_q1", 0.25), ("res_median", 0.5), ("res_q3", 0.75), ("res_max", 1)))
    + " FROM (SELECT y - intercept - slope * x AS r FROM {points}, {line})", line=_LINE)
def _(fx):
    points = _points(fx)
    out = regression.residual_quartiles(points, regression.regression_sums(points))
    return rounded(out, *out.columns)


# Two-sided p of Student's t by Simpson's rule: the density from 0 to |t| over that from 0 to 60.
_P_STEPS = {
    "t_values": f"""
        SELECT dof, unnest([1, 2]) AS term, abs(unnest([{_LINE_COLUMNS['slope_t']},
               {_LINE_COLUMNS['intercept_t']}])) AS t FROM {{line}}""",
    "t_parts": """
        SELECT term, sum(c * (1 + (least(t, 60) * k / 4000) ** 2 / dof) ** (-(dof + 1) / 2.0E0))
                     * any_value(least(t, 60)) AS inner_part,
               sum(c * (1 + (60.0E0 * k / 4000) ** 2 / dof) ** (-(dof + 1) / 2.0E0)) * 60 AS whole
        FROM {t_values}, (SELECT k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
                          AS c FROM range(4001) AS g(k))
        GROUP BY term""",
}


@query("a11_p_values", f"""
    SELECT (SELECT n FROM {{line}}) AS n,
           max({r6_sql('greatest(1 - inner_part / whole, 0)')}) FILTER (term = 1) AS slope_p,
           max({r6_sql('greatest(1 - inner_part / whole, 0)')}) FILTER (term = 2) AS intercept_p
    FROM {{t_parts}}""", line=_LINE, **_P_STEPS)
def _(fx):
    out = regression.with_p_values(regression.with_errors(
        regression.regression_sums(_points(fx)))).select("n", "slope_p", "intercept_p")
    return rounded(out, "slope_p", "intercept_p")


_CORRELATION = r6_sql(
    "regr_sxy(y, x) / nullif(sqrt(regr_sxx(y, x)) * sqrt(regr_syy(y, x)), 0)")


@query("a12_correlation", f"SELECT {r6_sql('corr(y, x)')} AS correlation FROM {{points}}")
def _(fx):
    return rounded(regression.correlation(_points(fx)), "correlation")


@query("a12_mortality_year_correlation",
       f"SELECT {_CORRELATION} AS correlation FROM {{event_points}}",
       event_points=_EVENT_POINTS)
def _(fx):
    return rounded(regression.correlation(_event_points(fx)), "correlation")


_HEXAGONS = {
    "hex_unit": """
        SELECT *, floor(x0 / wx) * wx - 1e-6 AS bx, floor(y0 / wy) * wy - 1e-6 AS y_base,
               1 / wx AS cx, 1 / (wy * sqrt(3.0E0)) AS cy
        FROM (SELECT (max(x) - min(x)) / 30 AS wx, (max(y) - min(y)) / 30 AS wy, min(x) AS x0,
                     min(y) AS y0 FROM {points})""",
    "hex_scaled": """
        SELECT *, cx * (x - bx) AS sx, cy * (y - y_base) AS sy FROM {points}, {hex_unit}""",
    "hex_near": """
        SELECT *, (sx - floor(sx + 0.5)) ** 2 + 3 * (sy - floor(sy + 0.5)) ** 2
               <= (sx - floor(sx) - 0.5) ** 2 + 3 * (sy - floor(sy) - 0.5) ** 2 AS whole
        FROM {hex_scaled}""",
    "hex_placed": """
        SELECT bx, y_base, cx, cy, CASE WHEN whole THEN floor(sx + 0.5) ELSE floor(sx) + 0.5 END AS i,
               CASE WHEN whole THEN floor(sy + 0.5) ELSE floor(sy) + 0.5 END AS j
        FROM {hex_near}""",
}


@query("a13_hexagon_counts", f"""
    SELECT {r6_sql('bx + i / cx')} AS hex_x, {r6_sql('y_base + j / cy')} AS hex_y, count(*) AS count
    FROM {{hex_placed}} GROUP BY bx, y_base, cx, cy, i, j""", **_HEXAGONS)
def _(fx):
    return rounded(density2d.hexagon_counts(_points(fx)), "hex_x", "hex_y")


def _kernel_steps(n: int) -> dict[str, str]:
    return {
        "spots": "SELECT x, y, count(*) AS copies FROM {points} GROUP BY x, y",
        "width": """
            SELECT 1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))
                                / 1.34) * count(*) ** -0.2E0 AS hx,
                   1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25))
                                / 1.34) * count(*) ** -0.2E0 AS hy,
                   count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1
            FROM {points}""",
        "gx": f"""
            SELECT i, x, exp(-0.5 * ((x0 + i * (x1 - x0) / {n - 1} - x) / hx) ** 2) AS kx
            FROM (SELECT DISTINCT x FROM {{spots}}), {{width}}, range({n}) AS r(i)""",
        "gxy": "SELECT i, y, sum(copies * kx) AS kx FROM {spots} JOIN {gx} USING (x) GROUP BY i, y",
        "gy": f"""
            SELECT i, j, kx * exp(-0.5 * ((y0 + j * (y1 - y0) / {n - 1} - y) / hy) ** 2) AS k
            FROM {{gxy}}, {{width}}, range({n}) AS r(j)""",
        "summed": "SELECT i, j, sum(k) AS k FROM {gy} GROUP BY i, j",
    }



def _kernel_sql(n: int) -> str:
    return f"""
        SELECT {r6_sql(f'x0 + i * (x1 - x0) / {n - 1}')} AS x,
               {r6_sql(f'y0 + j * (y1 - y0) / {n - 1}')} AS y,
               {r6_sql('1000 * k / (n * hx * hy * 2 * pi())')} AS density
        FROM {{summed}}, {{width}}"""


def _kernel(fx, n: int):
    density = density2d.kernel_density(_points(fx), n)
    return rounded(density.withColumn("density", F.col("density") * 1000), "x", "y", "density")


@query("a14_kernel_density", _kernel_sql(20), **_kernel_steps(20))
def _(fx):
    return _kernel(fx, 20)


@query("a14_kernel_density_full_grid", _kernel_sql(75), **_kernel_steps(75))
def _(fx):
    return _kernel(fx, 75)


# The 97.5 % quantile of Student's t by its expansion around the normal one, exact to the sixth
# decimal from some forty degrees of freedom on.
_Z = 1.959963984540054
_T_SQL = (f"({_Z} + {(_Z ** 3 + _Z) / 4!r} / dof + {(5 * _Z ** 5 + 16 * _Z ** 3 + 3 * _Z) / 96!r} / dof ** 2"
          f" + {(3 * _Z ** 7 + 19 * _Z ** 5 + 17 * _Z ** 3 - 15 * _Z) / 384!r} / dof ** 3)")
_SE_SQL = "sigma * sqrt(1.0E0 / n + (x - mx) ** 2 / sxx)"


@query("a15_fitted_line", f"""
    SELECT {r6_sql('x')} AS x, {r6_sql('intercept + slope * x')} AS fit, {r6_sql(_SE_SQL)} AS se,
           {r6_sql(f'intercept + slope * x - {_T_SQL} * {_SE_SQL}')} AS lower,
           {r6_sql(f'intercept + slope * x + {_T_SQL} * {_SE_SQL}')} AS upper
    FROM {{line}}, (SELECT x0 + (x1 - x0) * k / 79 AS x
                    FROM (SELECT min(x) AS x0, max(x) AS x1 FROM {{points}}), range(80) AS r(k))""",
       line=_LINE)
def _(fx):
    line = regression.fitted_line(_points(fx))
    return rounded(line, *line.columns)


@query("exact_quantiles_by_state", f"""
    SELECT STATECD, {r6_sql('quantile_cont(ACTUALHT, 0.1)')} AS q10,
           {r6_sql('quantile_cont(ACTUALHT, 0.5)')} AS q50 FROM {{fx_tree}} GROUP BY STATECD""")
def _(fx):
    out = exact_quantiles(fx.fx_tree, ["STATECD"], "ACTUALHT", {"q10": 0.1, "q50": 0.5})
    return rounded(out, "q10", "q50")
