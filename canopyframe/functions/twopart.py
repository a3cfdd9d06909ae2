"""The two-part Pareto density as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_normaliser(alpha_low: Column, alpha_high: Column, tau: Column, x_min: Column) -> Column:
    """Log of the constant that makes the two joined pieces integrate to one."""
    join = F.pow(tau, alpha_low - alpha_high)
    lower = join / alpha_low * (F.pow(x_min, -alpha_low) - F.pow(tau, -alpha_low))
    upper = F.pow(tau, -alpha_high) / alpha_high
    return -F.ln(lower + upper)


def two_part_log_density(x: Column, alpha_low: Column, alpha_high: Column, tau: Column,
                         x_min: Column) -> Column:
    """Log density at ``x``: power law ``alpha_low`` below ``tau`` and ``alpha_high`` from it on."""
    norm = log_normaliser(alpha_low, alpha_high, tau, x_min)
    below = norm + (alpha_low - alpha_high) * F.ln(tau) - (alpha_low + 1) * F.ln(x)
    above = norm - (alpha_high + 1) * F.ln(x)
    return F.when(x < tau, below).otherwise(above)
