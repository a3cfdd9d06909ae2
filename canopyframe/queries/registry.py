"""Query registry: a Spark function over the stand-in tables and, if expressible, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.fixtures import Fixtures, with_clause


@dataclass
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Fixtures(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, recursive: bool = False, **steps: str):
    """Register the decorated function; ``{step}`` in ``sql`` pulls in shared or own steps."""
    def wrap(build: Callable[[Fixtures], DataFrame]):
        text = None
        if sql is not None:
            extra = {**STEPS, **steps}
            if recursive:
                extra["__recursive__"] = ""
            text = with_clause(sql, extra)
        QUERIES[name] = Query(name, build, text)
        return build
    return wrap


def r6(column: Column) -> Column:
    """Six decimals by plain floating arithmetic, the same in both engines."""
    return F.floor(column * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def r6_sql(expr: str) -> str:
    return f"(floor(({expr}) * 1e6 + 0.5) / 1e6)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


_SA_COLUMNS = ("INVYR STATECD UNITCD COUNTYCD PLOT SUBP SPCD DIA STATUSCD SPGRPCD ACTUALHT "
               "TPA_UNADJ").split()

# Shared steps of the check SQL.
STEPS = {
    "cond_named": """
        SELECT *, concat_ws('_', STATECD, UNITCD, COUNTYCD, PLOT) AS pltID
        FROM {fx_cond} WHERE STDORGCD = 0 AND STDAGE IS NOT NULL""",
    "conditions": """
        SELECT *, CASE WHEN DisturbSum = 0 THEN 'No' ELSE 'Yes' END AS Disturbance
        FROM (SELECT *, DSTRBCD1 + DSTRBCD2 + DSTRBCD3 AS DisturbSum
              FROM (SELECT pltID, INVYR,
                           CASE WHEN count(*) = count(CONDPROP_UNADJ)
                                THEN sum(STDAGE * CONDPROP_UNADJ)
                                     / nullif(sum(CONDPROP_UNADJ), 0) END AS STDAGE,
                           coalesce(sum(DSTRBCD1), 0)::BIGINT AS DSTRBCD1,
                           coalesce(sum(DSTRBCD2), 0)::BIGINT AS DSTRBCD2,
                           coalesce(sum(DSTRBCD3), 0)::BIGINT AS DSTRBCD3
                    FROM {cond_named} GROUP BY pltID, INVYR))""",
    "plotcond": """
        SELECT p.INVYR, p.pltID, p.CN AS PLT_CN, p.STATECD, p.UNITCD, p.COUNTYCD, p.PLOT,
               p.KINDCD, p.DESIGNCD, p.LON, p.LAT, c.STDAGE, c.DSTRBCD1, c.DSTRBCD2, c.DSTRBCD3,
               c.DisturbSum, c.Disturbance
        FROM (SELECT *, concat_ws('_', STATECD, UNITCD, COUNTYCD, PLOT) AS pltID FROM {fx_plot}
              WHERE KINDCD NOT IN (0, 4)) p
        JOIN {conditions} c ON p.pltID = c.pltID AND p.INVYR = c.INVYR""",
    "kept_trees": """
        SELECT * FROM {fx_tree} WHERE STATUSCD = 1 AND CN NOT IN (SELECT cn FROM {fx_macro})""",
    "sa": f"""
        SELECT {', '.join('t.' + c for c in _SA_COLUMNS)}, t.CN AS TRE_CN, p.Disturbance,
               p.STDAGE, p.PLT_CN, p.KINDCD, p.DESIGNCD, p.LON, p.LAT, p.pltID
        FROM {{kept_trees}} t JOIN {{plotcond}} p
          ON t.INVYR = p.INVYR AND t.STATECD = p.STATECD AND t.UNITCD = p.UNITCD
         AND t.COUNTYCD = p.COUNTYCD AND t.PLOT = p.PLOT""",
    "measured": "SELECT * FROM {sa} WHERE DIA > 5 AND INVYR >= 2001",
    "tickets": """
        SELECT *, ('0x' || substr(md5(concat_ws('|', '01282024', pltID, TRE_CN)), 1, 15))::BIGINT
                  AS one_ticket
        FROM {measured}""",
    "visits": """
        SELECT pltID, INVYR, count(*) AS N_trees, bool_or(KINDCD = 3) AS replaced,
               bool_or(Disturbance <> 'No') AS disturbed, min(one_ticket) AS ticket
        FROM {tickets} GROUP BY pltID, INVYR HAVING count(*) >= 10""",
    "flagged": """
        SELECT *, bool_or(replaced) OVER (PARTITION BY pltID ORDER BY INVYR) AS KINDCD1
        FROM {visits}""",
    "marked": """
        SELECT pltID, INVYR, N_trees, ticket, KINDCD1, Description,
               CASE WHEN Description THEN 'Yes' ELSE 'No' END AS Disturbance
        FROM (SELECT *, bool_or(disturbed) OVER (PARTITION BY pltID ORDER BY INVYR) AS Description
              FROM {flagged})""",
    "sampled": "SELECT pltID, arg_min(INVYR, ticket) AS INVYR FROM {marked} GROUP BY pltID",
    "chosen": """
        SELECT m.*, row_number() OVER (ORDER BY m.pltID) AS Plot_Num
        FROM {marked} m JOIN {sampled} s ON m.pltID = s.pltID AND m.INVYR = s.INVYR""",
    "analysis": """
        SELECT t.* EXCLUDE (Disturbance), c.N_trees, c.KINDCD1, c.Description, c.Disturbance,
               c.Plot_Num
        FROM {measured} t JOIN {chosen} c ON t.pltID = c.pltID AND t.INVYR = c.INVYR""",
    "filled_mort": "SELECT pltID, YEAR, PLT_CN, coalesce(MORT_PERC, 0) AS MORT_PERC FROM {fx_mort}",
    "running": """
        SELECT *, max(MORT_PERC) OVER (PARTITION BY pltID ORDER BY YEAR) AS Max_Mort
        FROM {filled_mort}""",
    "history": """
        SELECT *, YEAR - Max_Mort_Year AS Years_Since_Max_Mort
        FROM (SELECT *, min(YEAR) OVER (PARTITION BY pltID, Max_Mort ORDER BY YEAR)
                        AS Max_Mort_Year FROM {running})""",
    "filled_visit_mort":
        "SELECT pltID, YEAR, PLT_CN, coalesce(MORT_PERC, 0) AS MORT_PERC FROM {fx_visit_mort}",
    "visit_history": """
        SELECT *, min(YEAR) OVER (PARTITION BY pltID, Max_Mort ORDER BY YEAR) AS Max_Mort_Year
        FROM (SELECT *, max(MORT_PERC) OVER (PARTITION BY pltID ORDER BY YEAR) AS Max_Mort
              FROM {filled_visit_mort})""",
    "first_trees": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PLT_CN ORDER BY INVYR, TRE_CN) rn
                       FROM {sa}) WHERE rn = 1""",
    "mort_visits": """
        SELECT h.pltID, f.PLT_CN, f.INVYR, h.Max_Mort, h.Max_Mort_Year, f.Disturbance,
               CASE WHEN f.Disturbance = 'Yes' THEN 1 ELSE 0 END AS Disturbance_Flag
        FROM {first_trees} f JOIN {visit_history} h ON f.PLT_CN = h.PLT_CN AND f.INVYR = h.YEAR""",
    "single": """
        SELECT v.pltID, v.PLT_CN, v.INVYR, v.Max_Mort, v.Max_Mort_Year, v.Disturbance_Flag,
               p.Year_of_Disturbance
        FROM {mort_visits} v JOIN (
            SELECT pltID, max(CASE WHEN Disturbance_Flag = 1 THEN INVYR ELSE 0 END)
                          AS Year_of_Disturbance
            FROM {mort_visits} GROUP BY pltID HAVING sum(Disturbance_Flag) = 1) p
          ON v.pltID = p.pltID""",
    "first_single": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY pltID ORDER BY INVYR, PLT_CN) rn
            FROM {single}) WHERE rn = 1""",
    "event_visits": """
        SELECT s.* FROM {single} s JOIN (
            SELECT * FROM {first_single} WHERE Max_Mort_Year = Year_of_Disturbance) e
          ON s.pltID = e.pltID AND s.Max_Mort_Year = e.Max_Mort_Year
         AND s.INVYR = e.Year_of_Disturbance""",
    "labelled": """
        SELECT *, CASE WHEN DSTRBCD1 = 0 THEN 'No Disturbance' WHEN DSTRBCD1 = 10 THEN
            'Insect Damage' WHEN DSTRBCD1 = 80 THEN 'Human-Caused Damage' WHEN DSTRBCD1 = 22 THEN
            'Disease Damage' WHEN DSTRBCD1 = 30 THEN 'Fire (Crown and Ground)' WHEN DSTRBCD1 = 31
            THEN 'Ground Fire' WHEN DSTRBCD1 = 32 THEN 'Crown Fire' WHEN DSTRBCD1 IN (46, 40) THEN
            'Animal Damage/Grazing' WHEN DSTRBCD1 = 52 THEN 'Wind' WHEN DSTRBCD1 IN (95, 91) THEN
            'Landslides/Earthquakes' WHEN DSTRBCD1 = 110 THEN 'Tree Cutting' END
            AS Disturbance_Type
        FROM {fx_attributes}""",
    "model_rows": """
        SELECT s.PLT_CN, s.corrected_slope, s.se_mean, s.sd, a.FINAL_PLT_ID, a.STDAGE, a.DSTRBCD1,
               a.MAX_HEIGHT, a.ECODE_NAME AS region, a.Time_Since_Dist, a.Disturbance_Type,
               s.se_mean / s.sd AS error
        FROM {fx_slopes} s JOIN {labelled} a ON s.PLT_CN = a.PLT_CN
        WHERE STDAGE <= 900 AND STDAGE > 0 AND DSTRBCD1 IN (0, 10, 22, 46, 40, 30, 31, 80, 52)
          AND MAX_HEIGHT > 0 AND corrected_slope < 0 AND ECODE_NAME <> ''""",
    "type_rows": """
        SELECT m.*, t.Treated, log10(STDAGE) AS log_age, log10(MAX_HEIGHT) AS log_height,
               corrected_slope AS y
        FROM {model_rows} m JOIN {fx_treatment} t ON m.PLT_CN = t.PLT_CN
        WHERE NOT (Disturbance_Type = 'No Disturbance' AND Treated = 'Yes')""",
    "trigger_rows": """
        SELECT FINAL_PLT_ID, Actual_Dist FROM (
            SELECT *, Disturbance_Type AS Actual_Dist,
                   row_number() OVER (PARTITION BY FINAL_PLT_ID ORDER BY PLT_CN) rn
            FROM {model_rows} WHERE Time_Since_Dist = 0
              AND Disturbance_Type IN ('Ground Fire', 'Animal Damage/Grazing')) WHERE rn = 1""",
    "time_rows": """
        SELECT m.*, t.Actual_Dist, log10(STDAGE) AS log_age, log10(MAX_HEIGHT) AS log_height,
               corrected_slope AS y
        FROM {model_rows} m JOIN {trigger_rows} t ON m.FINAL_PLT_ID = t.FINAL_PLT_ID""",
    "points": "SELECT DIA AS x, ACTUALHT AS y FROM {fx_tree}",
}


def sa(fx: Fixtures) -> DataFrame:
    from canopyframe.plans.prepare import size_abundance
    return size_abundance(fx.fx_cond, fx.fx_plot, fx.fx_tree, fx.fx_macro)

