"""Positions and exact quantiles that hold for keys of any size.

Positions are a sort, and a sort spreads over tasks by range: rows are range-partitioned on
(keys, order), every partition counts its own rows, and the counts of the preceding partitions
are added. The ranges come from a sample, so the sorted rows are written once and read back.

Quantiles need no sort of all rows. A key with few rows is one array in one shuffle. The keys that
are left, of which there are few by construction, are counted: a pass tells in which of ``BINS``
cells between a key's ends each wanted rank lies and what the smallest and largest value in that cell
are; the next pass looks between those only, until both are one value. A pass shuffles counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.functions.measures import quantile_of_sorted
from canopyframe.session import materialize

SMALL_GROUP = 10_000       # rows of a key that always fit an array
HOT_SHARE = 100_000        # a larger key is counted if it holds more than 1 / HOT_SHARE of all rows
BINS = 1024
COUNTING_PASSES = 25       # values spread too unevenly to be told apart by then are sorted by range

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row below bit 33


def _range_sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return materialize(ordered).withColumn(
        "_part", F.shiftright("_pos", _POSITION_BITS).cast("int"))


def number_distinct(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct values of ``key`` numbered 1, 2, ... in ascending order."""
    rows = _range_sorted(df.select(key).distinct(), [key])
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_lo"))
    # One row per partition, so this un-partitioned window stays as small as the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_lo",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "_part").select(
        key, (F.col("_before") + F.col("_pos") - F.col("_lo") + 1).alias(name))


def _quantiles_by_range(df: DataFrame, keys: list[str], value: str,
                        probs: dict[str, float]) -> DataFrame:
    spots = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_copies"))
    rows = _range_sorted(spots, [*keys, value])
    slices = rows.groupBy(*keys, "_part").agg(F.sum("_copies").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    slices = slices.select(
        *keys, "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"))
    # Inside one (key, partition) slice: at most a range partition's worth of distinct values.
    within = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (
        rows.withColumn("_upto", F.sum("_copies").over(within))
        .join(slices, [*keys, "_part"])
        .withColumn("_last", F.col("_before") + F.col("_upto") - 1)
        .withColumn("_first", F.col("_last") - F.col("_copies") + 1)
    )
    picks = []
    for name, prob in probs.items():
        position = (F.col("_total") - 1) * F.lit(float(prob))
        low = F.floor(position)
        high = F.least(low + 1, F.col("_total") - 1)
        share = position - low
        at_low = F.max(F.when(low.between(F.col("_first"), F.col("_last")), F.col(value)))
        at_high = F.max(F.when(high.between(F.col("_first"), F.col("_last")), F.col(value)))
        picks.append((at_low + F.max(share) * (at_high - at_low)).alias(name))
    return ranked.groupBy(*keys).agg(*picks)


def _split(rows: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys small enough for an array, and a written copy of the others' (None: there are
    none)."""
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    large = sizes.filter(F.col("_n") > max(SMALL_GROUP, total // HOT_SHARE)).drop("_n")
    if large.isEmpty():
        return rows, None
    # Fewer than HOT_SHARE keys, whatever the table.
    names = large.toDF(*[f"_k{i}" for i in range(len(keys))])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (rows.join(F.broadcast(names), same, "left_anti"),
            materialize(rows.join(F.broadcast(names), same, "left_semi")))


def _counted_ranks(rows: DataFrame, keys: list[str], value: str,
                   probs: Sequence[float]) -> DataFrame | None:
    """(keys, rank, v): the values at the two ranks around every quantile; None if counting doesn't
    settle."""
    v = F.col(value).cast("double")
    ends = materialize(rows.groupBy(*keys).agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n")))
    infinite = float("inf")
    if not ends.filter(F.isnan("hi") | (F.abs("lo") == infinite) | (F.abs("hi") == infinite)).isEmpty():
        return None
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[r for x in at for r in (
        F.floor(x), F.least(F.floor(x) + 1, F.col("n") - 1))]))
    state = ends.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("below"), ranks.alias("ranks"))
    names = [f"_k{i}" for i in range(len(keys))]
    done = None
    for _ in range(COUNTING_PASSES):
        settled = state.filter("lo = hi").select(
            *keys, F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
        done = settled if done is None else done.unionByName(settled)
        state = state.filter("lo < hi")
        if state.isEmpty():
            return done
        # A few intervals per key, none of which overlap; keys are bounded, so is the broadcast.
        cells = state.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "lo", "hi", "below",
                             "ranks")
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
        cell = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS),
                       F.lit(BINS - 1)).alias("bin")
        counts = rows.join(F.broadcast(cells), [*same, v >= F.col("lo"), v <= F.col("hi")]).groupBy(
            *keys, "lo", "hi", "below", "ranks", cell).agg(
                F.count(F.lit(1)).alias("c"), F.min(v).alias("least"), F.max(v).alias("most"))
        before = Window.partitionBy(*keys, "lo").orderBy("bin").rowsBetween(
            Window.unboundedPreceding, -1)
        counts = counts.withColumn("start", F.col("below") + F.coalesce(F.sum("c").over(before),
                                                                        F.lit(0)))
        mine = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("c")))
        state = materialize(counts.withColumn("mine", mine).filter(F.size("mine") > 0).select(
            *keys, F.col("least").alias("lo"), F.col("most").alias("hi"),
            F.col("start").alias("below"), F.col("mine").alias("ranks")))
    return None


def _quantiles_by_counting(rows: DataFrame, keys: list[str], value: str,
                           probs: dict[str, float]) -> DataFrame:
    found = _counted_ranks(rows, keys, value, list(probs.values()))
    if found is None:
        return _quantiles_by_range(rows, keys, value, probs)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    table = found.groupBy(*keys).agg(F.map_from_entries(
        F.collect_list(F.struct("rank", "v"))).alias("_at"))
    names = [f"_k{i}" for i in range(len(keys))]
    table = table.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_at")
    joined = sizes.join(table, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    picks = []
    for name, prob in probs.items():
        position = (F.col("_n") - 1) * F.lit(float(prob))
        low = F.element_at("_at", F.floor(position))
        high = F.element_at("_at", F.least(F.floor(position) + 1, F.col("_n") - 1))
        picks.append((low + (position - F.floor(position)) * (high - low)).alias(name))
    return joined.select(*keys, *picks)


def _with_arrays(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One sorted array of doubles, ``_v``, and its size, ``_n``, per key."""
    return (rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_v"))
            .withColumn("_n", F.size("_v")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key, one column per entry of ``probs``.

    NULL values are skipped. Without ``keys`` the result is one row for the whole table.
    """
    keys = list(keys)
    if not keys:
        one = exact_quantiles(df.select(F.lit(0).alias("_all"), value), ["_all"], value, probs)
        return one.groupBy().agg(*[F.max(name).alias(name) for name in probs])
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    small, large = _split(rows, keys, value)
    out = _with_arrays(small, keys, value).select(*keys, *[
        quantile_of_sorted(F.col("_v"), F.col("_n"), p).alias(name) for name, p in probs.items()])
    return out if large is None else out.unionByName(
        _quantiles_by_counting(large, keys, value, probs))


def summarise_groups(df: DataFrame, keys: Sequence[str], value: str,
                     fixed_size: int | None = None) -> DataFrame:
    """Mean, median, sd, mad, 5 % and 95 % quantile of ``value`` per key.

    ``mad`` is scaled by 1.4826. ``fixed_size`` states that no group can have more rows by
    construction (one per chain, say), so that none needs to be looked for that is too large for an
    array.
    """
    keys = list(keys)
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    if fixed_size is not None:
        return _summarised_as_arrays(rows, keys, value)
    small, large = _split(rows, keys, value)
    out = _summarised_as_arrays(small, keys, value)
    return out if large is None else out.unionByName(_summarised_by_counting(large, keys, value))


def _summarised_as_arrays(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
             F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_v"))
        .withColumn("_n", F.size("_v"))
        .withColumn("median", quantile_of_sorted(F.col("_v"), F.col("_n"), 0.5))
        .withColumn("_d", F.array_sort(F.transform("_v", lambda x: F.abs(x - F.col("median")))))
        .select(*keys, "mean", "median", "sd",
                (F.lit(1.4826) * quantile_of_sorted(F.col("_d"), F.col("_n"), 0.5)).alias("mad"),
                quantile_of_sorted(F.col("_v"), F.col("_n"), 0.05).alias("q5"),
                quantile_of_sorted(F.col("_v"), F.col("_n"), 0.95).alias("q95"))
    )


def _summarised_by_counting(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For the few keys with very many rows; ``rows`` is a written copy of theirs."""
    names = [f"_s{i}" for i in range(len(keys))]

    def matched(left: DataFrame, right: DataFrame) -> DataFrame:
        side = right.toDF(*names, *right.columns[len(keys):])
        return left.join(F.broadcast(side), [F.col(k).eqNullSafe(F.col(n))
                                             for k, n in zip(keys, names)]).drop(*names)

    moments = rows.groupBy(*keys).agg(F.avg(value).alias("mean"),
                                      F.stddev_samp(value).alias("sd"))
    spots = materialize(_quantiles_by_counting(rows, keys, value,
                                               {"q5": 0.05, "median": 0.5, "q95": 0.95}))
    distances = matched(rows, spots.select(*keys, "median")).select(
        *keys, F.abs(F.col(value) - F.col("median")).alias("_d"))
    mads = _quantiles_by_counting(distances, keys, "_d", {"_mad": 0.5})
    return matched(matched(moments, spots), mads).select(
        *keys, "mean", "median", "sd", (F.lit(1.4826) * F.col("_mad")).alias("mad"), "q5", "q95")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The whole first row of every key in the given order.

    The rank filter is applied before the shuffle as well (window group limit), so a hot key
    sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
