"""Plot links, components, tree identities and region adjacency."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.operators import linking, modeldata, spatial
from canopyframe.queries.registry import query

_VISITS = "SELECT DISTINCT PLT_CN, FULL_TREE_ID FROM {fx_link} WHERE INVYR > 2001"
_STARS = """
    SELECT DISTINCT PLT_CN AS hi, lo FROM {link_visits} v
    JOIN (SELECT FULL_TREE_ID, min(PLT_CN) AS lo FROM {link_visits} GROUP BY FULL_TREE_ID) s
      ON v.FULL_TREE_ID = s.FULL_TREE_ID WHERE PLT_CN <> lo"""
_BOTH = "SELECT hi AS a, lo AS b FROM {stars} UNION SELECT lo, hi FROM {stars}"
_REACH = """
    SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM {links})
    UNION SELECT r.node, e.b FROM reach r JOIN {links} e ON r.seen = e.a"""
_GRAPH = {"link_visits": _VISITS, "stars": _STARS, "links": _BOTH, "reach": _REACH}
_COMPONENTS = "SELECT node AS PLT_CN, min(seen) AS new_plot_ID FROM {reach} GROUP BY node"


@query("j7_identified_trees", """
    SELECT t.CN, t.PLT_CN, t.DIA, i.tree AS FULL_TREE_ID FROM {fx_tree} t
    JOIN (SELECT CN, concat_ws('/', l_suppkey, l_partkey) AS tree FROM {fx_chain}
          WHERE STATUSCD = 1) i ON t.CN = i.CN""")
def _(fx):
    identity = fx.fx_chain.filter("STATUSCD = 1").select(
        "CN", F.concat_ws("/", "l_suppkey", "l_partkey").alias("FULL_TREE_ID"))
    return linking.identified_trees(fx.fx_tree, identity).select(
        "CN", "PLT_CN", "DIA", "FULL_TREE_ID")


@query("j8_f13_visit_links", "SELECT hi, lo FROM {stars}", **_GRAPH)
def _(fx):
    return linking.visit_links(linking.tree_visits(fx.fx_link))


@query("j8_ordered_pair_counts", """
    SELECT FULL_TREE_ID, count(*) AS ordered_pairs, count(DISTINCT a.PLT_CN) AS visits
    FROM {link_visits} a JOIN {link_visits} b USING (FULL_TREE_ID)
    WHERE a.PLT_CN <> b.PLT_CN GROUP BY FULL_TREE_ID""", **_GRAPH)
def _(fx):
    return linking.shared_tree_pairs(linking.tree_visits(fx.fx_link))


@query("g1_connected_components", _COMPONENTS, recursive=True, **_GRAPH)
def _(fx):
    return linking.plot_components(fx.fx_link)


@query("g1_dense_numbers", f"""
    SELECT PLT_CN, dense_rank() OVER (ORDER BY new_plot_ID) AS new_plot_ID
    FROM ({_COMPONENTS})""", recursive=True, **_GRAPH)
def _(fx):
    return linking.plot_components(fx.fx_link, dense=True)


@query("j9_g2_attach_components", f"""
    SELECT l.PLT_CN, l.FULL_TREE_ID, l.INVYR, c.new_plot_ID
    FROM {{fx_link}} l LEFT JOIN ({_COMPONENTS}) c ON l.PLT_CN = c.PLT_CN
    WHERE l.INVYR >= 2001""", recursive=True, **_GRAPH)
def _(fx):
    return linking.attach_components(fx.fx_link, linking.plot_components(fx.fx_link)).select(
        "PLT_CN", "FULL_TREE_ID", "INVYR", "new_plot_ID")


@query("x3_tree_identity", """
    SELECT CN, min(CN) OVER (PARTITION BY l_suppkey, l_partkey) AS FULL_TREE_ID
    FROM {fx_chain}""")
def _(fx):
    return linking.tree_identity(fx.fx_chain)


def _regions(fx):
    return spatial.regions_in(modeldata.model_rows(
        modeldata.slopes_with_attributes(fx.fx_slopes, fx.fx_attributes)))


def _few_regions(fx):
    return spatial.regions_in(fx.nation.filter("n_nationkey % 3 <> 0"), "n_name")


_FEW = "SELECT n_name AS region FROM nation WHERE n_nationkey % 3 <> 0"


@query("a8_regions_in_data", "SELECT DISTINCT region FROM {model_rows}")
def _(fx):
    return _regions(fx)


@query("u4_common_regions", """
    SELECT region_a AS region FROM {fx_adj} INTERSECT SELECT region FROM {few}""", few=_FEW)
def _(fx):
    return spatial.common_regions(fx.fx_adj, _few_regions(fx))


@query("u5_regions_outside", """
    SELECT region_a AS region FROM {fx_adj} EXCEPT SELECT region FROM {few}""", few=_FEW)
def _(fx):
    return spatial.matrix_regions(fx.fx_adj).subtract(_few_regions(fx))


@query("j18_restricted_edges", """
    SELECT region_a, region_b FROM {fx_adj}
    WHERE region_a IN (FROM {few}) AND region_b IN (FROM {few})""", few=_FEW)
def _(fx):
    return spatial.restrict_edges(fx.fx_adj, _few_regions(fx))


@query("g3_checked_edges", "SELECT region_a, region_b FROM {fx_adj}")
def _(fx):
    return spatial.checked_edges(fx.fx_adj, _regions(fx))
