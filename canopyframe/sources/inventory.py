"""Readers for per-state CSV folders.

Files are matched by name, columns by header. State files of one table may list their columns in
a different order or lack some, so files are grouped by their header line and each group becomes
one multi-file scan; the groups are stacked by column name. A scan stays splittable whatever the
size of a state's file.
"""

from __future__ import annotations

import csv
import posixpath
import re
from collections import defaultdict
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyframe import schemas
from canopyframe.functions.measures import null_if_nan
from canopyframe.operators.prep import stacked
from canopyframe.sources.catalog import (
    CONTIGUOUS_STATES,
    check_states,
    check_tables,
    file_stems,
)

CSV_OPTIONS = {"header": "true", "nullValue": "NA", "nanValue": "NaN", "mode": "FAILFAST"}


def list_files(spark: SparkSession, folder: str, pattern: str, glob: str = "*.csv") -> list[str]:
    """Files of ``folder`` whose whole name matches ``pattern``; only the listing is read."""
    rx = re.compile(pattern)
    found = spark.read.option("pathGlobFilter", glob).text(folder).inputFiles()
    paths = [unquote(p) for p in found]
    return sorted(p for p in paths if rx.fullmatch(posixpath.basename(p)))


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Column names of every file, from one job that keeps each file's first line.

    A line's place is its split's offset and its number inside the split; the aggregate combines on
    the map side, so a file of any size sends one line per task.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"), "value").filter(
            (F.col("at") == 0) & (F.trim("value") != ""))
    first = {unquote(r["path"]): r["value"] for r in lines.groupBy("path").agg(
        F.min_by("value", "row").alias("value")).collect()}
    names: dict[str, tuple[str, ...]] = {}
    out = {}
    for path in paths:
        text = _found(first, path)
        if text not in names:
            names[text] = tuple(next(csv.reader([text.lstrip("\ufeff")]))) if text else ()
        out[path] = names[text]
    return out


def _found(first: dict[str, str], path: str) -> str:
    """The line of ``path``, whose scheme and authority may be written differently."""
    if path in first:
        return first[path]
    bare = urlparse(path).path
    return next((v for k, v in first.items() if urlparse(k).path == bare), "")


def read_csv_files(spark: SparkSession, paths: Sequence[str],
                   schema: T.StructType | None = None,
                   fill_missing: bool = True) -> DataFrame:
    """Stack CSV files by column name.

    With a ``schema`` its columns are returned with their declared types: extra file columns are
    pruned from the scan and, with ``fill_missing``, absent ones are NULL. Without a schema every
    column is text. ``fill_missing=False`` rejects files that lack a column.
    """
    if not paths:
        raise FileNotFoundError("no matching CSV file")
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, header in _headers(spark, paths).items():
        by_header[header].append(path)
    if schema is not None:
        declared = {f.name: f.dataType for f in schema.fields}
    else:
        declared = {c: T.StringType() for header in by_header for c in header}
    parts = []
    for header, files in by_header.items():
        missing = [c for c in declared if c not in header]
        if missing and not fill_missing:
            raise ValueError(f"{files[0]} lacks columns: {', '.join(missing)}")
        scan_schema = T.StructType(
            [T.StructField(c, declared.get(c, T.StringType()), True) for c in header])
        parts.append(spark.read.options(**CSV_OPTIONS).schema(scan_schema).csv(files).select(*[
            _clean(c, kind) if c in header else F.lit(None).cast(kind).alias(c)
            for c, kind in declared.items()
        ]))
    return stacked(parts)


def _clean(name: str, kind: T.DataType):
    column = F.col(f"`{name}`")
    return (null_if_nan(column) if isinstance(kind, T.DoubleType) else column).alias(name)


def scan_table(spark: SparkSession, folder: str, table: str,
               states: Sequence[str] = CONTIGUOUS_STATES,
               fill_missing: bool = True) -> DataFrame:
    """All ``<STATE>_<TABLE>.csv`` files of the given states as one DataFrame.

    The name is matched as a whole, so ``CA_OZONE_PLOT.csv`` is never taken for a plot file.
    """
    # The bundle of all states has no prefix.
    codes = "|".join("" if s == "ENTIRE" else re.escape(s) + "_" for s in check_states(states))
    paths = list_files(spark, folder, rf"({codes}){re.escape(table)}\.csv", f"*{table}.csv")
    return read_csv_files(spark, paths, schemas.BY_TABLE.get(table), fill_missing)


def load_inventory(spark: SparkSession, folder: str, states: Sequence[str],
                   tables: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Named tables of the requested states, each stacked over the states; nothing is read yet."""
    stems = file_stems(check_states(states), check_tables(tables))
    loaded = {}
    for table, names in stems.items():
        pattern = "|".join(re.escape(n) for n in names)
        paths = list_files(spark, folder, rf"({pattern})\.csv", f"*{table}.csv")
        absent = set(names) - {posixpath.basename(p)[:-4] for p in paths}
        if absent:
            raise FileNotFoundError(f"missing in {folder}: {', '.join(sorted(absent))}")
        loaded[table] = read_csv_files(spark, paths, schemas.BY_TABLE.get(table))
    return loaded


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make the loaded tables available to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def read_folder(spark: SparkSession, folder: str, schema: T.StructType,
                pattern: str = r".*\.csv") -> DataFrame:
    """Every matching CSV of a folder, stacked by column name."""
    return read_csv_files(spark, list_files(spark, folder, pattern), schema)


def read_intermediate(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result written by an earlier stage: Parquet as is, CSV with its declared schema."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return read_csv_files(spark, [path], schema)


def read_macroplot_list(spark: SparkSession, path: str) -> DataFrame:
    """Record keys of macroplot trees (column ``cn``), to be excluded from the tree table."""
    return read_intermediate(spark, path, schemas.MACROPLOT)
