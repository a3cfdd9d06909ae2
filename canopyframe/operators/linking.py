"""Links between surveys of the same plot: visits that share a tree belong together.

A tree seen in k visits is turned into k - 1 star links from its smallest visit, which connect
the same visits as all k * (k - 1) ordered pairs would. Components are then found with
alternating large-star and small-star rounds, a number of rounds that grows with the logarithm
of the graph, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from canopyframe.operators.ranking import number_distinct
from canopyframe.session import materialize

# A node holding more than 1 / HOT_SHARE of all links on one side, and more than HOT_LINKS, is looked
# up through a broadcast. There can be at most HOT_SHARE such nodes a side, so the broadcast is bounded
# whatever the size of the graph.
HOT_SHARE = 1000
HOT_LINKS = 100


def identified_trees(tree: DataFrame, identity: DataFrame) -> DataFrame:
    """Trees with their identity across surveys (``FULL_TREE_ID``)."""
    names = identity.select(F.col("CN").cast("string").alias("CN"), "FULL_TREE_ID")
    return tree.withColumn("CN", F.col("CN").cast("string")).join(names, on="CN", how="inner")


def tree_visits(rows: DataFrame, after_year: int = 2001) -> DataFrame:
    """Distinct (visit, tree) of surveys after ``after_year``; unidentified trees are dropped."""
    return (
        rows.filter(F.col("INVYR") > after_year)
        .select(F.col("PLT_CN").cast("string").alias("PLT_CN"), "FULL_TREE_ID")
        .dropna(subset=["FULL_TREE_ID"])
        .distinct()
    )


def visit_links(visits: DataFrame) -> DataFrame:
    """Links (``hi``, ``lo``) from every visit of a tree to the tree's smallest visit."""
    smallest = visits.groupBy("FULL_TREE_ID").agg(F.min("PLT_CN").alias("lo"))
    return (
        visits.join(smallest, on="FULL_TREE_ID", how="inner")
        .filter(F.col("PLT_CN") != F.col("lo"))
        .select(F.col("PLT_CN").alias("hi"), "lo")
        .distinct()
    )


def shared_tree_pairs(visits: DataFrame) -> DataFrame:
    """Per tree: its visits and the number of ordered visit pairs they stand for."""
    return (
        visits.groupBy("FULL_TREE_ID").agg(F.count(F.lit(1)).alias("visits"))
        .withColumn("ordered_pairs", F.col("visits") * (F.col("visits") - 1))
        .filter(F.col("visits") > 1)
    )


def _star_round(links: DataFrame, total: int) -> DataFrame:
    """Links after one large-star and one small-star step.

    One aggregate finds every node's smallest neighbour below it and its number of links on either
    side; links are moved to the node below them once and to the node above them once. The links of a
    hot node are dealt evenly instead: below, as its row of the aggregate is broadcast; above, in
    groups that each settle on their own smallest neighbour, which later rounds bring together.
    """
    most = max(total / HOT_SHARE, HOT_LINKS)
    ends = links.select(F.inline(F.array(
        F.struct(F.col("hi").alias("_node"), F.col("lo").alias("_up"), F.lit(None).alias("_down")),
        F.struct(F.col("lo").alias("_node"), F.lit(None).alias("_up"), F.col("hi").alias("_down")))))
    # Every reader below asks for all three columns, so that the aggregate is shuffled once.
    nodes = ends.groupBy("_node").agg(
        F.min("_up").alias("up"), F.count("_up").alias("_ups"), F.count("_down").alias("_downs"))
    dealt = links.withColumns({"_hot": F.lit(None), "_key": F.col("lo").cast("long"), "_deal": F.lit(0)})
    if total > most:
        hot = F.broadcast(nodes.filter(F.greatest("_ups", "_downs") > most))
        below, above = hot.alias("below"), hot.filter("up is not null").alias("above")
        is_hot = F.coalesce(F.col("below._downs") > most, F.lit(False))
        dealt = (links.join(below, F.col("lo") == F.col("below._node"), "left")
                 .join(above, F.col("hi") == F.col("above._node"), "left")
                 .select("hi", "lo", F.when(is_hot, F.coalesce("below.up", "lo")).alias("_hot"),
                         F.when(is_hot, F.xxhash64("hi", "lo")).otherwise(F.col("lo")).alias("_key"),
                         F.when(F.col("above._ups") > most, F.pmod(
                             F.xxhash64("lo"), F.ceil(F.col("above._ups") / most)))
                         .otherwise(0).alias("_deal")))
    # Large star: every node above ``lo`` is moved to the smallest neighbour of ``lo``.
    parents = nodes.filter("_ups > 0 and _downs > 0").select(
        F.col("_node").cast("long").alias("_key"), "up")
    large = dealt.join(parents, "_key", "left").select(
        "hi", "_deal", F.coalesce("_hot", "up", "lo").alias("lo"))
    # Small star: all smaller neighbours of a node, and the node itself, move to the smallest.
    least = F.min("lo").over(Window.partitionBy("hi", "_deal"))
    return (large.withColumn("_least", least)
            .select(F.inline(F.array(F.struct("hi", F.col("_least").alias("lo")),
                                     F.struct(F.col("lo").alias("hi"), F.col("_least").alias("lo")))))
            .filter("hi != lo").distinct())


def _settled(links: DataFrame, max_rounds: int) -> DataFrame:
    """Every node's link to its component's smallest node.

    ``links`` (hi, lo) hold numbers, so the rounds' minima are hash aggregates of fixed width. Each
    round is written to the checkpoint folder and counted while it is written, so neither the
    lineage nor the loss of an executor makes earlier rounds run again, and none is read for a
    comparison alone.
    """
    links, state = _counted(links)
    for _ in range(max_rounds):
        if state[0] == 0:
            return links
        links, after = _counted(_star_round(links, state[0]))
        if state == after:
            return links
        state = after
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _counted(links: DataFrame) -> tuple[DataFrame, tuple]:
    """Written links with their count and a sum of hashes."""
    seen = Observation()
    kept = materialize(links.observe(
        seen, F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("hash")))
    return kept, (seen.get["n"], seen.get["hash"])


def connected_components(edges: DataFrame, a: str, b: str, node: str = "node",
                         component: str = "component", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Nodes that are text are numbered in their order first and named again at the end. The number of
    rounds grows with the logarithm of the graph; ``max_rounds`` only stops a run that would never
    settle, with an error.
    """
    oriented = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    if dict(oriented.dtypes)["hi"] in ("int", "bigint"):
        links = _settled(oriented, max_rounds)
    else:
        oriented = materialize(oriented)
        nodes = oriented.select(F.col("hi").alias("_name")).unionByName(
            oriented.select(F.col("lo").alias("_name")))
        numbers = materialize(number_distinct(nodes, "_name", "_number"))

        def swapped(rows: DataFrame, side: str, given: str, wanted: str) -> DataFrame:
            other = numbers.select(F.col(given).alias(side), F.col(wanted).alias("_new"))
            return rows.join(other, side).drop(side).withColumnRenamed("_new", side)

        numbered = swapped(swapped(oriented, "hi", "_name", "_number"), "lo", "_name", "_number")
        found = _settled(numbered.select("hi", "lo"), max_rounds)
        links = swapped(swapped(found, "hi", "_number", "_name"), "lo", "_number", "_name")
    return links.select(F.inline(F.array(
        F.struct(F.col("hi").alias(node), F.col("lo").alias(component)),
        F.struct(F.col("lo").alias(node), F.col("lo").alias(component))))).distinct()


def extended_components(known: DataFrame, edges: DataFrame, a: str, b: str, node: str = "node",
                        component: str = "component", max_rounds: int = 100) -> DataFrame:
    """``known`` components after some more ``edges``, as a run over all edges would give them.

    The new edges are mapped to the components their ends are known in, and only that contracted
    graph is run; the old edges aren't needed.
    """
    ends = edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    for end in ("_a", "_b"):
        names = known.select(F.col(node).alias(end), F.col(component).alias("_known"))
        ends = ends.join(names, end, "left").withColumn(f"{end}c", F.coalesce("_known", end)).drop(
            "_known")
    ends = materialize(ends)
    merged = materialize(connected_components(ends, "_ac", "_bc", "_from", "_to", max_rounds))
    fresh = ends.select(F.explode(F.array("_a", "_b")).alias(node))
    every = known.select(node, component).unionByName(
        fresh.distinct().join(known.select(node), node, "left_anti").select(
            node, F.col(node).alias(component)))
    return every.join(merged, F.col(component) == F.col("_from"), "left").select(
        node, F.coalesce("_to", component).alias(component))


def with_new_visits(known: DataFrame, visits: DataFrame, new_visits: DataFrame) -> DataFrame:
    """``plot_components`` of ``visits`` brought up to date with the visits of further surveys.

    ``known`` has the components of the earlier ``visits`` (both as (PLT_CN, FULL_TREE_ID) rows of
    ``tree_visits``). Only trees that are seen in the new surveys are looked at.
    """
    trees = new_visits.select("FULL_TREE_ID").distinct()
    touched = visits.select("PLT_CN", "FULL_TREE_ID").join(trees, "FULL_TREE_ID", "left_semi")
    links = visit_links(touched.unionByName(new_visits.select(
        "PLT_CN", "FULL_TREE_ID"), allowMissingColumns=False).distinct())
    return extended_components(known, links, "hi", "lo", "PLT_CN", "new_plot_ID")


def plot_components(rows: DataFrame, after_year: int = 2001, dense: bool = False) -> DataFrame:
    """``PLT_CN`` -> ``new_plot_ID``: the smallest linked visit, or 1, 2, ... with ``dense``."""
    links = visit_links(tree_visits(rows, after_year))
    found = connected_components(links, "hi", "lo", "PLT_CN", "new_plot_ID")
    if not dense:
        return found
    numbers = number_distinct(found, "new_plot_ID", "_number")
    return found.join(numbers, "new_plot_ID").select(
        "PLT_CN", F.col("_number").alias("new_plot_ID"))


def attach_components(rows: DataFrame, components: DataFrame, first_year: int = 2001,
                      fill_singletons: bool = False) -> DataFrame:
    """Rows from ``first_year`` on with their component; unlinked visits keep NULL unless filled."""
    out = (
        rows.filter(F.col("INVYR") >= first_year)
        .withColumn("PLT_CN", F.col("PLT_CN").cast("string"))
        .join(components, on="PLT_CN", how="left")
    )
    if fill_singletons:
        out = out.withColumn("new_plot_ID", F.coalesce(
            F.col("new_plot_ID").cast("string"), F.col("PLT_CN")))
    return out


def tree_identity(tree: DataFrame) -> DataFrame:
    """``CN`` -> ``FULL_TREE_ID`` from the chain of previous record keys."""
    keys = tree.select(F.col("CN").cast("string").alias("CN"),
                       F.col("PREV_TRE_CN").cast("string").alias("PREV_TRE_CN"))
    chains = connected_components(keys.dropna(), "CN", "PREV_TRE_CN", "CN", "_tree")
    return keys.select("CN").join(chains, on="CN", how="left").select(
        "CN", F.coalesce("_tree", "CN").alias("FULL_TREE_ID"))
