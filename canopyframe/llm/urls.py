"""URL filters: prefix rules as key intervals, found by a sorted sweep over rules and pages."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Production rules: (verdict, host, path).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
DEFAULT = "allow"
PARTS_PER_TASK = 4         # key ranges per shuffle partition
DRAWS_PER_PART = 25        # page keys drawn per range to place its borders
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def reversed_host(host: Column) -> Column:
    """Labels from last to first, each followed by a dot: a host and its subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``pages``.

    A rule (verdict, host, path) fits its host and all subdomains if the page's path starts with the
    rule's; of several the longest ``host + path`` wins, at equal length the greatest text and
    verdict. Without a rule: ``rule`` null and the default verdict.

    Keys are reversed hosts, so a rule is the interval of keys with its prefix; intervals nest or are
    apart. Pages are cut into ranges of (key, id) whose borders come from a bounded draw, so one busy
    host fills several ranges. A rule goes to each range that it reaches into. In a range a sweep in
    key order keeps the open rules on a stack: rules that end are popped, and what is left encloses
    the page's host.

    A null url or one without ``://`` has empty host and path, which no rule fits; rules with a null
    part or an empty host are ignored; repeated rows repeat; other columns are ignored; either table
    may be empty.
    """
    spark = pages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col)
    own = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"),
                       path_of(url).alias("path"))
    own = own.withColumn("key", F.when(F.col("host") != "", reversed_host(F.col("host")))
                         .otherwise(F.lit("")))
    # A tie-breaker cuts a host's pages into several ranges.
    own = own.withColumn("salt", F.xxhash64("id", "path"))
    parts = tasks * PARTS_PER_TASK
    draw = (own.select("key", "salt").orderBy(F.xxhash64("salt"), "salt", "key")
            .limit(parts * DRAWS_PER_PART))
    drawn = sorted((r["key"], r["salt"]) for r in draw.collect())
    borders = sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if drawn else []
    sent = spark.sparkContext.broadcast(borders)

    def page_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect_right(sent.value, at)
                    for at in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), batch.column(3), pa.array([1] * len(part), pa.int32()),
                 pa.array([""] * len(part)), *batch.columns[:3],
                 pa.array([None] * len(part), pa.string())], names)

    names = ["part", "key", "kind", "upto", "id", "host", "path", "verdict"]
    schema = ("part int, key string, kind int, upto string, id long, host string, path string, "
              "verdict string")

    def rule_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for verdict, host, path, key, upto in zip(*(c.to_pylist() for c in batch.columns)):
                low = bisect_right(sent.value, (key, -(2 ** 63)))
                high = bisect_right(sent.value, (upto, -(2 ** 63)))
                rows += [(part, key, 0, upto, None, host, path, verdict)
                         for part in range(low, high + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(
                    zip(*rows) if rows else [[]] * 8,
                    [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(),
                     pa.string(), pa.string()])], names)

    fit = (rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path")
           .filter("verdict is not null and host <> '' and path is not null").distinct()
           .withColumn("key", reversed_host(F.col("host")))
           # The last dot becomes the next character: the end of all keys with this prefix.
           .withColumn("upto", F.expr("concat(substring(key, 1, length(key) - 1), '/')")))
    both = own.mapInArrow(page_part, schema).unionByName(fit.mapInArrow(rule_parts, schema))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_rules = None, []
        for batch in batches:
            out = []
            for row_part, key, kind, upto, page, host, path, verdict in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if row_part != part:
                    part, open_rules = row_part, []
                while open_rules and open_rules[-1][0] <= key:
                    open_rules.pop()
                if kind == 0:
                    open_rules.append((upto, host, path, verdict))
                    continue
                fits = [(len(h) + len(p), h + p, v) for _, h, p, v in open_rules
                        if path.startswith(p)]
                best = max(fits, default=(0, None, default))
                out.append((page, host, path, best[1], best[2]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(
                    zip(*out) if out else [[]] * 5,
                    [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()])],
                ["id", "host", "path", "rule", "verdict"])

    return (both.repartition(tasks, "part")
            .sortWithinPartitions("part", "key", "kind", F.desc("upto"))
            .mapInArrow(sweep, "id long, host string, path string, rule string, verdict string")
            .withColumnRenamed("id", id_col))


def _sql() -> str:
    fits = []
    for verdict, host, path in RULES:
        fits.append(f"SELECT '{host}' AS h, '{path}' AS p, '{verdict}' AS v")
    return f"""
WITH r AS ({' UNION ALL '.join(fits)}),
u AS (SELECT page_id, row_number() OVER () AS k,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                  '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
f AS (SELECT k, h || p AS rule, v, row_number() OVER (
          PARTITION BY k ORDER BY length(h || p) DESC, h || p DESC, v DESC) AS rn
      FROM u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict
FROM u LEFT JOIN f ON u.k = f.k AND rn = 1"""


SQL = _sql()
