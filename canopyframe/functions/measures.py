"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CM_PER_INCH = 2.54


def inches_to_cm(value: Column) -> Column:
    return value * F.lit(CM_PER_INCH)


def error_ratio(se_mean: Column, sd: Column) -> Column:
    """``se_mean / sd`` as the models use it; NULL where ``sd`` is zero."""
    return F.try_divide(se_mean, sd)


def slope_from_exponent(variable: Column, exponent: Column) -> Column:
    """Size-abundance slope ``-(alpha + 1)`` for the exponents of either fit, NULL otherwise."""
    return F.when(variable.isin("alpha", "alpha_low", "alpha_high"), -(exponent + 1))


def zero_if_missing(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def null_if_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def event_year(flag: Column, year: Column) -> Column:
    """The year of a flagged row and 0 for all others."""
    return F.when(flag == 1, year).when(flag.isNotNull(), 0)


def years_since(year: Column, event: Column) -> Column:
    return year - event


def quantile_of_sorted(values: Column, size: Column, prob: float) -> Column:
    """Linear-interpolation quantile of an ascending array (the usual type-7 definition)."""
    position = (size - 1) * F.lit(float(prob))
    low = F.floor(position).cast("int")
    below = F.get(values, low)
    above = F.get(values, F.least(low + 1, size - 1))
    return below + (position - low) * (above - below)
