"""Disturbance codes, flags, labels and dummy columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_LEVEL = "No Disturbance"

# Disturbance code -> label.
DISTURBANCE_LABELS = {
    0: "No Disturbance",
    10: "Insect Damage",
    80: "Human-Caused Damage",
    22: "Disease Damage",
    30: "Fire (Crown and Ground)",
    31: "Ground Fire",
    32: "Crown Fire",
    46: "Animal Damage/Grazing",
    40: "Animal Damage/Grazing",
    52: "Wind",
    95: "Landslides/Earthquakes",
    91: "Landslides/Earthquakes",
    110: "Tree Cutting",
}

# Codes kept for the slope models.
MODEL_CODES = (0, 10, 22, 46, 40, 30, 31, 80, 52)

# Disturbances followed through time.
TRACKED_DISTURBANCES = ("Ground Fire", "Animal Damage/Grazing")

# Treatment code -> description.
TREATMENT_CODES = {
    0: "No observable treatment",
    10: "Cutting",
    20: "Site preparation",
    30: "Artificial regeneration",
    40: "Natural regeneration",
    50: "Other silvicultural treatment",
}


def disturbance_sum(*codes: str) -> Column:
    """Sum of the disturbance code columns; only zero against non-zero carries meaning."""
    total = F.lit(0)
    for name in codes or ("DSTRBCD1", "DSTRBCD2", "DSTRBCD3"):
        total = total + F.col(name)
    return total


def disturbed_yes_no(total: Column) -> Column:
    return F.when(total == 0, "No").when(total.isNotNull(), "Yes")


def yes_no_flag(value: Column) -> Column:
    """1 for ``Yes``, 0 for any other value, NULL stays NULL."""
    return F.when(value == "Yes", 1).when(value.isNotNull(), 0)


def disturbance_label(code: Column) -> Column:
    """Label of a disturbance code, NULL for codes without a label."""
    by_label: dict[str, list[int]] = {}
    for value, label in DISTURBANCE_LABELS.items():
        by_label.setdefault(label, []).append(value)
    expr = None
    for label, values in by_label.items():
        cond = code.isin(values)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def treated_yes_no(code: Column) -> Column:
    """``Yes`` for a treatment code other than 00, NULL for codes outside the list."""
    return F.when(code == 0, "No").when(code.isin([c for c in TREATMENT_CODES if c]), "Yes")


def levels_after_base(levels: Iterable[str], base: str = BASE_LEVEL) -> list[str]:
    """The non-base levels in alphabetical order, which is the order of their dummy columns."""
    return sorted(set(levels) - {base})


def add_dummies(df: DataFrame, column: str, levels: Iterable[str], base: str = BASE_LEVEL,
                prefix: str = "is_") -> DataFrame:
    """One 0/1 column per non-base level; the names number the levels in alphabetical order."""
    names = levels_after_base(levels, base)
    return df.withColumns({
        f"{prefix}{i}": F.when(F.col(column) == level, 1.0).when(F.col(column).isNotNull(), 0.0)
        for i, level in enumerate(names, start=1)
    })
