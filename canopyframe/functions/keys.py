"""Plot keys and key casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLOT_KEY_PARTS = ("STATECD", "UNITCD", "COUNTYCD", "PLOT")


def plot_key(*parts: str) -> Column:
    """``STATECD_UNITCD_COUNTYCD_PLOT``; a missing part is spelled ``NA`` instead of skipped."""
    names = parts or PLOT_KEY_PARTS
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in names])


def text_key(name: str) -> Column:
    """Record keys are opaque text: 64-bit record numbers do not survive a trip through double."""
    return F.col(name).cast("string").alias(name)


def md5_bits(*parts: Column, hex_digits: int = 15) -> Column:
    """The leading ``hex_digits`` of an md5 over ``parts`` as a long.

    A long, not a string, so that a ``min_by`` over it stays in the fixed-width hash aggregate.
    """
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("long")
