import random

import pytest
from pyspark.sql import functions as F

from canopyframe.operators import linking
from canopyframe.plans.link_plots import trees_with_plot_ids
from conftest import as_dict


ROWS = "PLT_CN string, FULL_TREE_ID string, INVYR int"


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def components(spark, edges, **options):
    df = spark.createDataFrame(edges, "a string, b string")
    return as_dict(linking.connected_components(df, "a", "b", **options), "node", "component")


def test_random_graph_with_a_hub(spark):
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(150)]
    edges += [("n150", f"m{i}") for i in range(120)] + [("x", "x")]
    assert components(spark, edges) == brute_components(edges)


def test_long_chain_settles_in_few_rounds(spark):
    names = [f"{i:04d}" for i in range(600)]
    random.Random(2).shuffle(names)
    edges = list(zip(names, names[1:]))
    found = components(spark, edges, max_rounds=14)
    assert set(found) == set(names) and set(found.values()) == {"0000"}


def test_numbers_as_nodes(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = as_dict(linking.connected_components(df, "a", "b"), "node", "component")
    assert found == brute_components(edges)


@pytest.mark.parametrize("seed", range(4))
def test_added_edges_equal_a_run_from_scratch(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(120):03d}"
    old = [(name(), name()) for _ in range(60)]
    new = [(name(), name()) for _ in range(25)] + [("z1", "z2"), ("z2", "z3"), ("z9", "z9")]
    schema = "a string, b string"
    known = linking.connected_components(spark.createDataFrame(old, schema), "a", "b")
    grown = linking.extended_components(known, spark.createDataFrame(new, schema), "a", "b")
    assert as_dict(grown, "node", "component") == brute_components(old + new)
    assert grown.count() == len(brute_components(old + new))
    same = linking.extended_components(known, spark.createDataFrame([], schema), "a", "b")
    assert as_dict(same, "node", "component") == brute_components(old)


def test_a_survey_year_added_to_a_map_equals_the_run_from_scratch(spark):
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(80):02d}-{year}", f"t{rng.randrange(90)}", year)
            for year in (2002, 2005, 2009) for _ in range(60)]
    df = spark.createDataFrame(rows, ROWS)
    before, after = df.filter("INVYR < 2009"), df.filter("INVYR = 2009")
    known = linking.plot_components(before)
    grown = linking.with_new_visits(known, linking.tree_visits(before), linking.tree_visits(after))
    assert as_dict(grown, "PLT_CN", "new_plot_ID") == as_dict(
        linking.plot_components(df), "PLT_CN", "new_plot_ID")


def test_rounds_use_hash_aggregates(spark):
    links = spark.createDataFrame([(2, 1), (3, 2)], "hi long, lo long")
    plan = linking._star_round(links, 2)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_round_shuffles_links_few_times(spark):
    rows = [(i, i % 7) for i in range(7, 400)] + [(1000, i) for i in range(300)]
    links = spark.createDataFrame(rows, "hi long, lo long")
    found = linking._star_round(links, len(rows))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("- Exchange hashpartitioning") <= 4
    assert {r.lo for r in found.filter("hi = 1000").collect()} <= set(range(7))


@pytest.mark.parametrize("seed", range(3))
def test_hot_nodes_on_both_sides(spark, monkeypatch, seed):
    monkeypatch.setattr(linking, "HOT_LINKS", 3)
    rng = random.Random(seed)
    edges = [(500, i) for i in range(0, 400, 3)] + [(7, i) for i in range(8, 300, 5)]
    edges += [(rng.randrange(1000), rng.randrange(1000)) for _ in range(200)]
    df = spark.createDataFrame(edges, "a int, b int")
    found = linking.connected_components(df, "a", "b")
    assert as_dict(found, "node", "component") == brute_components(edges)
    assert found.count() == len(brute_components(edges))
    assert dict(found.dtypes) == {"node": "int", "component": "int"}


def test_no_edges(spark):
    assert components(spark, [("a", "a")]) == {}


def test_star_links_connect_what_pairs_connect(spark):
    rng = random.Random(5)
    rows = [(f"p{rng.randrange(60):02d}", f"t{rng.randrange(40)}", 2005) for _ in range(90)]
    df = spark.createDataFrame(rows, ROWS)
    visits = linking.tree_visits(df)
    links = [(r.hi, r.lo) for r in linking.visit_links(visits).collect()]
    seen = {(r.PLT_CN, r.FULL_TREE_ID) for r in visits.collect()}
    pairs = [(a, b) for a, t in seen for b, u in seen if t == u and a != b]
    assert brute_components(links) == brute_components(pairs)
    counts = as_dict(linking.shared_tree_pairs(visits), "FULL_TREE_ID", "ordered_pairs")
    assert sum(counts.values()) == len(pairs)


def test_years_null_trees_and_singletons(spark):
    df = spark.createDataFrame([
        ("a", "t1", 2005), ("b", "t1", 2010), ("c", "t2", 2005), ("d", "t2", 2001),
        ("e", None, 2005), ("f", None, 2006), ("g", "t3", 2000)], ROWS)
    found = linking.plot_components(df)
    assert as_dict(found, "PLT_CN", "new_plot_ID") == {"a": "a", "b": "a"}
    assert as_dict(linking.plot_components(df, after_year=2000), "PLT_CN", "new_plot_ID") == {
        "a": "a", "b": "a", "c": "c", "d": "c"}
    joined = as_dict(linking.attach_components(df, found), "PLT_CN", "new_plot_ID")
    assert joined == {"a": "a", "b": "a", "c": None, "d": None, "e": None, "f": None}
    filled = as_dict(linking.attach_components(df, found, fill_singletons=True), "PLT_CN",
                     "new_plot_ID")
    assert filled["c"] == "c" and filled["b"] == "a"
    assert as_dict(linking.plot_components(df, after_year=2000, dense=True), "PLT_CN",
                   "new_plot_ID") == {"a": 1, "b": 1, "c": 2, "d": 2}


def test_components_are_idempotent(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y")]
    once = components(spark, edges)
    again = components(spark, [(k, v) for k, v in once.items()])
    assert once == again == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_plan_and_tree_identity(spark):
    tree = spark.createDataFrame([
        ("1", None, "p1", 2002), ("2", "1", "p2", 2007), ("3", "2", "p3", 2012),
        ("8", None, "p9", 2012)], "CN string, PREV_TRE_CN string, PLT_CN string, INVYR int")
    identity = linking.tree_identity(tree)
    assert as_dict(identity, "CN", "FULL_TREE_ID") == {"1": "1", "2": "1", "3": "1", "8": "8"}
    out = trees_with_plot_ids(tree.withColumn("CN", F.col("CN").cast("long")), identity)
    assert as_dict(out, "PLT_CN", "new_plot_ID") == {"p1": "p1", "p2": "p1", "p3": "p1",
                                                     "p9": None}
