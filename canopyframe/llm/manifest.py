"""Merkle manifest of a data set with octopus multiproofs.

Every row is a leaf; the leaves of one group form a binary hash tree, the groups' roots another one.
``build`` gives a manifest: placed leaves and all nodes as tables. ``prove`` lets every partition of
leaves compute the smallest set of node coordinates that its leaves' proofs need and that it cannot
derive itself (the octopus set), fetches each once, derives the interiors that its leaves share, and
expands each leaf's own proof from them.

Trees of any size are built from blocks of at most 1,024 neighbouring nodes, a few rounds of levels
at a time; no group, nor the list of groups, is ever held by one task or the driver.

Cases: null fields count as ``-``; a null group is a group of its own and comes first; null order
keys come first; rows that repeat are leaves of their own, rows with equal order keys are ordered by
their leaf; an empty table has no rows and no root; texts of any length are hashed by the JVM; other
columns are left out, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.common import written
from canopyframe.operators.ranking import number_distinct
from canopyframe.session import materialize

ROUND_LEVELS = 10          # levels that one block of neighbouring nodes climbs
PART_LEAVES = 1 << 16      # leaves of one partition, about
TOP = -1                   # stands for the tree over the groups' roots
ROW_BITS = 33              # monotonically_increasing_id: partition above, row below bit 33

NODES = "g long, level int, at long, hash string"


def node_hash(texts: Sequence[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# --- leaves ------------------------------------------------------------------------------------

def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(grp, key, leaf, tampered) of ``documents``; ``tampered`` is null where nothing is changed."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = list(fields)
    changed[3] = F.col("n_chars").cast("decimal(20,0)") + 1
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) \
        & F.col("n_chars").isNotNull()
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"),
                       leaf_hash(fields).alias("leaf"),
                       F.when(chosen, leaf_hash(changed)).alias("tampered"))


# --- positions ---------------------------------------------------------------------------------

def place(leaves: DataFrame) -> DataFrame:
    """Leaves as (part, g, at, n, key, leaf, tampered): place ``at`` among the ``n`` of group ``g``.

    One range sort of the slim rows; places follow from the counts of (partition, group) runs. Rows
    with equal keys are interchangeable, so the row number that splits them may be any.
    """
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-leaves.count() // PART_LEAVES))
    order = [F.col(c).asc_nulls_first() for c in ("grp", "key", "leaf", "row")]
    rows = materialize(leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                       .drop("row").withColumn("_pos", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("_pos", ROW_BITS).cast("int")).withColumn(
        "_pos", F.col("_pos").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    runs = rows.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("m"), F.min("_pos").alias("lo"))
    # A group has at most one run per partition, so its window is as small as their number.
    group = Window.partitionBy("grp")
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumns({"before": F.coalesce(F.sum("m").over(earlier), F.lit(0)),
                                     "n": F.sum("m").over(group)}), "runs")
    numbers = number_distinct(runs, "grp", "g").withColumnRenamed("grp", "grp2")
    runs = written(runs.join(numbers, F.col("grp").eqNullSafe(F.col("grp2"))).select(
        F.col("part").alias("part2"), F.col("grp").alias("grp2"), (F.col("g") - 1).alias("g"),
        "n", (F.col("before") - F.col("lo")).alias("shift")), "places")
    return rows.join(
        runs, (F.col("part") == F.col("part2")) & F.col("grp").eqNullSafe(F.col("grp2"))).select(
        "part", "g", (F.col("_pos") + F.col("shift")).alias("at"), "n", "key", "leaf", "tampered")


# --- nodes -------------------------------------------------------------------------------------

def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    return (n - 1).bit_length()


def width(n: int, level: int) -> int:
    """Nodes at ``level`` over ``n`` leaves."""
    return -(-n >> level)


def _height(n: str) -> Column:
    return F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0)


def _climb(table: pa.Table) -> pa.Table:
    """All nodes above one block, up to ``ROUND_LEVELS`` levels or the root."""
    table = table.sort_by("at")
    g, n, level = (table.column(c)[0].as_py() for c in ("g", "n", "level"))
    at, nodes = table.column("at")[0].as_py(), table.column("hash").to_pylist()
    levels, places, hashes = [], [], []
    for level in range(level + 1, min(level + ROUND_LEVELS, height(n)) + 1):
        nodes = [node_hash(nodes[k:k + 2]) for k in range(0, len(nodes), 2)]
        at >>= 1
        levels += [level] * len(nodes)
        places += range(at, at + len(nodes))
        hashes += nodes
    k = len(hashes)
    return pa.table({"g": pa.array([g] * k, pa.int64()), "level": pa.array(levels, pa.int32()),
                     "at": pa.array(places, pa.int64()), "hash": pa.array(hashes, pa.string()),
                     "n": pa.array([n] * k, pa.int64())})


def _nodes(base: DataFrame, tallest: int) -> list[DataFrame]:
    """``base``, the nodes of level 0 with ``n``, and the written nodes of all levels above."""
    tables = [written(base, "nodes")]
    for bottom in range(0, tallest, ROUND_LEVELS):
        below = tables[-1].filter((F.col("level") == bottom) & (_height("n") > bottom))
        block = F.shiftright("at", ROUND_LEVELS).alias("block")
        tables.append(written(below.groupBy("g", block).applyInArrow(
            _climb, f"{NODES}, n long"), "nodes"))
    return tables


def build(placed: DataFrame) -> tuple[DataFrame, int]:
    """(nodes, number of groups): every node of every tree as (g, level, at, hash, n).

    Nodes of the tree over the groups' roots have ``g`` = -1.
    """
    own = placed.select("g", F.lit(0).alias("level"), "at", F.col("leaf").alias("hash"), "n")
    size = placed.agg(F.max("n"), F.max("g")).first()
    if size[0] is None:
        return written(own.limit(0), "nodes"), 0
    groups = size[1] + 1
    tables = _nodes(own, height(size[0]))
    roots = _union(tables).filter(F.col("level") == _height("n")).select(
        F.lit(TOP).cast("long").alias("g"), F.lit(0).alias("level"), F.col("g").alias("at"), "hash",
        F.lit(groups).cast("long").alias("n"))
    return _union(tables + _nodes(roots, height(groups))), groups


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


# --- proofs ------------------------------------------------------------------------------------

def missing(known: set[int], n: int) -> Iterator[tuple[int, int]]:
    """The octopus set: the fewest nodes that prove all ``known`` leaves of ``n``, as (level, at)."""
    for level in range(height(n)):
        last = width(n, level) - 1
        yield from ((level, k ^ 1) for k in sorted(known) if k ^ 1 not in known and k ^ 1 <= last)
        known = {k >> 1 for k in known}


def derive(known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Per level the nodes that ``known`` leaves and the fetched ones give, the root last."""
    levels = []
    for level in range(height(n)):
        known = known | {k ^ 1: fetched[level, k ^ 1] for k in known if (level, k ^ 1) in fetched}
        levels.append(known)
        known = {k: node_hash([known[c] for c in (2 * k, 2 * k + 1) if c in known])
                 for k in {k >> 1 for k in known}}
    return [*levels, known]


def siblings(levels: list[dict[int, str]], at: int) -> list[tuple[int, str]]:
    """One leaf's own proof: (side, hash) from the leaf up; side 1 means a right sibling."""
    out = []
    for level, nodes in enumerate(levels[:-1]):
        other = (at >> level) ^ 1
        # The last node of a level with no neighbour is hashed alone.
        out.append((other & 1, nodes[other]) if other in nodes else (1, ""))
    return out


def fold(leaf: str, path: list[tuple[int, str]]) -> str:
    for right, other in path:
        leaf = node_hash([leaf, other] if right else [other, leaf])
    return leaf


def _wanted(groups: int):
    def coordinates(table: pa.Table) -> pa.Table:
        part, rows = table.column("part")[0].as_py(), []
        own = table.to_pydict()
        for g, lo, hi, n in zip(own["g"], own["lo"], own["hi"], own["n"]):
            rows += [(part, g, *c) for c in missing(set(range(lo, hi + 1)), n)]
        rows += [(part, TOP, *c) for c in missing(set(own["g"]), groups)]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["part", "g", "level", "at"])
    return coordinates


def _expand(groups: int, kind: pa.DataType):
    def proofs(own: pa.Table, fetched: pa.Table) -> pa.Table:
        node = {}
        for g, level, at, text in zip(*(fetched.column(c).to_pylist()
                                        for c in ("g", "level", "at", "hash"))):
            node.setdefault(g, {})[level, at] = text
        members: dict[int, list[int]] = {}
        gs, ats, ns, leaves, changed = (own.column(c).to_pylist()
                                        for c in ("g", "at", "n", "leaf", "tampered"))
        for k, g in enumerate(gs):
            members.setdefault(g, []).append(k)
        trees = {g: derive({ats[k]: leaves[k] for k in rows}, ns[rows[0]], node.get(g, {}))
                 for g, rows in members.items()}
        top = derive({g: levels[-1][0] for g, levels in trees.items()}, groups, node.get(TOP, {}))
        root = top[-1][0]
        subroots, digests, folded, paths = [], [], [], []
        upper = {g: siblings(top, g) for g in trees}
        for k, g in enumerate(gs):
            path = siblings(trees[g], ats[k]) + upper[g]
            texts = [text for _, text in path if text]
            subroots.append(trees[g][-1][0])
            digests.append(node_hash(texts))
            paths.append(texts)
            folded.append(fold(leaves[k] if changed[k] is None else changed[k], path))
        return pa.table({
            "key": own.column("key").cast(kind), "leaf": own.column("leaf"), "subroot": subroots,
            "root": pa.array([root] * len(gs), pa.string()), "proof_sha256": digests,
            "folded_root": pa.array(folded, pa.string()),
            "proof": pa.array(paths, pa.list_(pa.string()))})
    return proofs


def prove(placed: DataFrame, nodes: DataFrame, groups: int) -> DataFrame:
    """Per leaf: key, leaf, subroot, root, proof_sha256, folded_root, proof (list of siblings).

    ``nodes`` may come from a stored manifest: what a partition cannot derive is fetched from it, so
    leaves that were changed since give another root.
    """
    runs = placed.groupBy("part", "g").agg(F.min("at").alias("lo"), F.max("at").alias("hi"),
                                           F.first("n").alias("n"))
    wanted = runs.groupBy("part").applyInArrow(_wanted(groups),
                                               "part int, g long, level int, at long")
    fetched = wanted.join(nodes.drop("n"), ["g", "level", "at"]).select(
        "part", "g", "level", "at", "hash")
    key = dict(placed.dtypes)["key"]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return placed.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(
        _expand(groups, kinds[key]),
        f"key {key}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, proof array<string>")


def document_manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    placed = place(document_leaves(docs))
    nodes, groups = build(placed)
    return prove(placed, nodes, groups).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


# Check SQL: the trees by recursion over levels, paths by joins per level. DuckDB has no crc32.
_CRC = """(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
  string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, _: xor(x >> 1, (x & 1) * 3988292384))))"""

_LEAF = """sha256(concat(
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
  coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
  coalesce(strlen(({n})::VARCHAR) || ':' || ({n}), '-'),
  coalesce(strlen(text) || ':' || text, '-')))"""

SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || lang, '') AS grp, {_LEAF.format(n='n_chars')} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
         THEN {_LEAF.format(n='n_chars::HUGEINT + 1')} ELSE {_LEAF.format(n='n_chars')} END AS used,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos
  FROM documents),
tree AS (
  SELECT grp, 0 AS level, pos, leaf AS hash FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM (
    SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM tree) WHERE n > 1
  GROUP BY grp, level, pos // 2),
sub AS (SELECT grp, arg_max(hash, level) AS hash, max(level) AS height FROM tree GROUP BY grp),
tops AS (
  SELECT row_number() OVER (ORDER BY grp) - 1 AS pos, 0 AS level, hash FROM sub
  UNION ALL
  SELECT pos // 2, level + 1, sha256(string_agg(hash, '' ORDER BY pos)) FROM (
    SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT arg_max(hash, level) AS hash FROM tops),
place AS (SELECT grp, hash, height, row_number() OVER (ORDER BY grp) - 1 AS g FROM sub),
steps AS (
  SELECT grp, leaves.pos AS leaf_pos, doc_id, level, (leaves.pos >> level) AS own,
    xor(leaves.pos >> level, 1) AS other
  FROM leaves JOIN place USING (grp) CROSS JOIN (SELECT unnest(range(64)) AS level)
  WHERE level < height
  UNION ALL
  SELECT grp, leaves.pos, doc_id, height + level, g >> level, xor(g >> level, 1)
  FROM leaves JOIN place USING (grp) CROSS JOIN (SELECT unnest(range(64)) AS level)
  WHERE level < (SELECT max(level) FROM tops)),
path AS MATERIALIZED (
  SELECT s.grp, s.leaf_pos, s.level, own % 2 AS right_hand,
    coalesce(CASE WHEN s.level < height THEN t.hash ELSE u.hash END, '') AS hash
  FROM steps s JOIN place p USING (grp)
  LEFT JOIN tree t ON t.grp = s.grp AND t.level = s.level AND t.pos = s.other
  LEFT JOIN tops u ON u.level = s.level - height AND u.pos = s.other),
proofs AS (
  SELECT grp, leaf_pos, sha256(string_agg(hash, '' ORDER BY level)) AS proof, max(level) AS top
  FROM path GROUP BY grp, leaf_pos),
folds AS (
  SELECT grp, pos, 0 AS level, used AS hash FROM leaves
  UNION ALL
  SELECT f.grp, f.pos, f.level + 1, sha256(CASE WHEN right_hand = 1 THEN p.hash || f.hash
                                               ELSE f.hash || p.hash END)
  FROM folds f JOIN path p ON p.grp = f.grp AND p.leaf_pos = f.pos AND p.level = f.level),
folded AS (SELECT grp, pos, arg_max(hash, level) AS hash FROM folds GROUP BY grp, pos)
SELECT doc_id, leaf, place.hash AS subroot, root.hash AS root,
  coalesce(proof, sha256('')) AS proof_sha256, folded.hash AS folded_root,
  folded.hash = root.hash AS verified
FROM leaves JOIN place USING (grp) JOIN folded USING (grp, pos) CROSS JOIN root
LEFT JOIN proofs ON proofs.grp = leaves.grp AND proofs.leaf_pos = leaves.pos
"""
