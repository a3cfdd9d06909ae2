"""Stand-in inventory tables built from the driver's tables.

Every stand-in is one SELECT that is valid in Spark and in DuckDB; ``{name}`` stands for another
table. ``Fixtures`` resolves them to DataFrames, ``with_clause`` to common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

_PLTID = "concat_ws('_', STATECD, UNITCD, COUNTYCD, PLOT)"

STAND_INS = {
    "tree_base": """
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) AS CN,
               CAST(s_nationkey AS INT) AS STATECD, CAST(n_regionkey AS INT) AS UNITCD,
               CAST(l_linenumber % 3 AS INT) AS COUNTYCD, CAST(l_suppkey AS INT) AS PLOT,
               CAST(year(l_shipdate) + 4 AS INT) AS INVYR,
               CAST(l_linenumber AS INT) AS SUBP, CAST(l_partkey % 100 AS INT) AS SPCD,
               CAST(l_partkey % 10 AS INT) AS SPGRPCD, l_quantity AS DIA,
               CASE l_returnflag WHEN 'N' THEN 2 ELSE 1 END AS STATUSCD,
               l_extendedprice / 1000 AS ACTUALHT, 1 + l_tax * 100 AS TPA_UNADJ,
               l_linestatus, l_discount, l_partkey, l_suppkey, l_shipdate
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} ON s_nationkey = n_nationkey""",
    "fx_tree": f"""
        SELECT INVYR, CN, CAST(NULL AS VARCHAR(40)) AS PREV_TRE_CN,
               concat_ws(':', {_PLTID}, INVYR) AS PLT_CN, STATUSCD, ACTUALHT, STATECD, UNITCD,
               COUNTYCD, PLOT, SUBP, SPCD, DIA, SPGRPCD, TPA_UNADJ
        FROM {{tree_base}}""",
    "fx_chain": f"""
        SELECT CN, lag(CN) OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, CN)
                   AS PREV_TRE_CN,
               concat_ws('_', STATECD, PLOT) AS pltID, INVYR,
               concat_ws(':', {_PLTID}, INVYR) AS PLT_CN, STATUSCD, TPA_UNADJ, l_suppkey, l_partkey
        FROM {{tree_base}}""",
    "fx_macro": "SELECT CN AS cn FROM {tree_base} WHERE l_linestatus = 'F' AND l_discount >= 0.09",
    "plot_visits": "SELECT DISTINCT STATECD, UNITCD, COUNTYCD, PLOT, INVYR FROM {tree_base}",
    "fx_plot": f"""
        SELECT concat_ws(':', {_PLTID}, INVYR) AS CN, INVYR, STATECD, UNITCD, COUNTYCD, PLOT,
               CASE (PLOT * 7 + INVYR) % 13 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 1 END
                   AS KINDCD,
               1 AS DESIGNCD, CAST(-70 - PLOT % 50 AS DOUBLE) AS LON,
               CAST(30 + PLOT % 15 AS DOUBLE) AS LAT
        FROM {{plot_visits}}""",
    "order_slots": """
        SELECT o_orderkey, o_orderdate, o_custkey % (SELECT count(*) FROM {supplier}) AS slot
        FROM {orders}""",
    "fx_cond": """
        SELECT CAST(s_nationkey AS INT) AS STATECD, CAST(n_regionkey AS INT) AS UNITCD,
               CAST(o_orderkey % 3 AS INT) AS COUNTYCD, CAST(s_suppkey AS INT) AS PLOT,
               CAST(year(o_orderdate) + 4 AS INT) AS INVYR,
               CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS STDORGCD,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    ELSE CAST(o_orderkey % 300 AS DOUBLE) END AS STDAGE,
               CASE WHEN o_orderkey % 53 = 0 THEN NULL
                    ELSE CAST(1 + o_orderkey % 4 AS DOUBLE) / 4 END AS CONDPROP_UNADJ,
               CASE o_orderkey % 97 WHEN 0 THEN 10 WHEN 1 THEN 22 WHEN 2 THEN 30 WHEN 3 THEN 31
                    WHEN 4 THEN 40 WHEN 5 THEN 46 WHEN 6 THEN 52 WHEN 7 THEN 80 WHEN 8 THEN 32
                    ELSE 0 END AS DSTRBCD1,
               0 AS DSTRBCD2, CAST(NULL AS INT) AS DSTRBCD3
        FROM {order_slots} JOIN {supplier} ON s_suppkey = slot
        JOIN {nation} ON s_nationkey = n_nationkey""",
    "fx_link": """
        SELECT PLT_CN, concat_ws('/', l_suppkey, l_partkey) AS FULL_TREE_ID, INVYR
        FROM {fx_chain}""",
    "mort_base": """
        SELECT l_suppkey AS supp, CAST(year(l_shipdate) + 4 AS INT) AS YEAR,
               100 * avg(CASE l_returnflag WHEN 'N' THEN 1.0E0 ELSE 0.0E0 END) AS perc
        FROM {lineitem} GROUP BY l_suppkey, CAST(year(l_shipdate) + 4 AS INT)""",
    "fx_mort": """
        SELECT CAST(supp AS VARCHAR(20)) AS pltID, YEAR, concat_ws(':', supp, YEAR) AS PLT_CN,
               CASE WHEN (supp + YEAR) % 9 = 0 THEN NULL ELSE perc END AS MORT_PERC
        FROM {mort_base}""",
    "fx_visit_mort": """
        SELECT concat_ws('_', STATECD, UNITCD, COUNTYCD, PLOT) AS pltID, INVYR AS YEAR, PLT_CN,
               CASE WHEN (PLOT + INVYR) % 9 = 0 THEN NULL
                    ELSE 100 * avg(CASE STATUSCD WHEN 2 THEN 1.0E0 ELSE 0.0E0 END) END AS MORT_PERC
        FROM {fx_tree} GROUP BY STATECD, UNITCD, COUNTYCD, PLOT, INVYR, PLT_CN""",
    "fx_draws": """
        SELECT user_id AS PLT_CN, event_type AS variable, CAST(event_id % 4 AS INT) AS chain,
               CAST(floor(event_id / 4) AS BIGINT) % 10 AS iteration, value
        FROM {events}""",
    "model_base": """
        SELECT o_orderkey, o_custkey, o_totalprice, n_name
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        JOIN {nation} ON c_nationkey = n_nationkey""",
    "fx_slopes": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS PLT_CN,
               CASE WHEN o_orderkey % 37 = 0 THEN 0.1E0 ELSE -(1 + o_totalprice / 200000) END
                   AS corrected_slope,
               0.001E0 * (1 + o_orderkey % 7) AS se_mean, 0.1E0 + 0.01E0 * (o_orderkey % 5) AS sd
        FROM {model_base}""",
    "fx_attributes": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS PLT_CN,
               CAST(o_custkey AS VARCHAR(20)) AS FINAL_PLT_ID,
               CAST(o_orderkey % 950 AS DOUBLE) AS STDAGE,
               CASE o_orderkey % 12 WHEN 3 THEN 10 WHEN 4 THEN 22 WHEN 5 THEN 30 WHEN 6 THEN 31
                    WHEN 7 THEN 40 WHEN 8 THEN 46 WHEN 9 THEN 52 WHEN 10 THEN 80 WHEN 11 THEN 95
                    ELSE 0 END AS DSTRBCD1,
               o_totalprice / 10000 AS MAX_HEIGHT,
               CASE WHEN o_custkey % 29 = 0 THEN '' ELSE n_name END AS ECODE_NAME,
               CAST((CAST(floor(o_orderkey / 12) AS BIGINT) % 4) * 5 AS DOUBLE) AS Time_Since_Dist
        FROM {model_base}""",
    "fx_treatment": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS PLT_CN,
               CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN NULL ELSE 'No' END AS Treated,
               CAST(o_orderkey % 7 * 10 AS INT) AS TRTCD1
        FROM {orders}""",
    "fx_adj": """
        SELECT a.n_name AS region_a, b.n_name AS region_b
        FROM {nation} a JOIN {nation} b
          ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


class Fixtures:
    """Lazily resolved stand-ins over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in BASE_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in STAND_INS:
                text = STAND_INS[name]
                used = {t: getattr(self, t) for t in set(_PLACEHOLDER.findall(text))}
                df = self.spark.sql(text, **used)
            else:
                raise AttributeError(name)
            self._known[name] = df
        return self._known[name]


def with_clause(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the common table expressions that its ``{name}``s need."""
    texts = {**STAND_INS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_PLACEHOLDER.findall(text)):
            if name in texts and name not in order:
                visit(texts[name])
                order.append(name)

    visit(body)

    def plain(text: str) -> str:
        return _PLACEHOLDER.sub(r"\1", text)

    if not order:
        return plain(body)
    ctes = ",\n".join(f"{name} AS ({plain(texts[name])})" for name in order)
    kind = "WITH RECURSIVE" if extra and "__recursive__" in extra else "WITH"
    return f"{kind} {ctes}\n{plain(body)}"
