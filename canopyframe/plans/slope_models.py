"""The two slope regressions, from tables to posterior summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.functions.disturbance import BASE_LEVEL
from canopyframe.operators import mixedmodel, modeldata, spatial
from canopyframe.plans.slopes import full_draw_measurements
from canopyframe.session import materialize


def disturbance_type_rows(slopes: DataFrame, attributes: DataFrame,
                          treatment: DataFrame) -> DataFrame:
    base = modeldata.slopes_with_attributes(slopes, attributes)
    kept = modeldata.without_treated_controls(modeldata.model_rows(base), treatment)
    return modeldata.with_covariates(kept)


def own_measurements(trees: DataFrame, plots: DataFrame, regions: DataFrame, table: DataFrame,
                     **options) -> tuple[DataFrame, DataFrame]:
    """(slopes, attributes) of the sampled visits in ``table``, from this library's own fits.

    ``trees`` are the size-abundance rows, ``plots`` the plots with their conditions, ``regions``
    gives ECODE_NAME by STATECD. What comes out is what ``disturbance_type_rows`` takes.
    """
    measured = full_draw_measurements(table, **options).drop("N_Trees")
    attributes = (
        plots.join(modeldata.max_height(trees), "PLT_CN").join(regions, "STATECD")
        .select("PLT_CN", F.col("pltID").alias("FINAL_PLT_ID"), "STDAGE", "DSTRBCD1", "MAX_HEIGHT",
                "ECODE_NAME"))
    return measured, attributes


def time_since_rows(slopes: DataFrame, attributes: DataFrame) -> DataFrame:
    rows = modeldata.model_rows(modeldata.slopes_with_attributes(slopes, attributes))
    followed = modeldata.follow_disturbance(rows, modeldata.triggering_disturbance(rows))
    return modeldata.with_covariates(followed)


def fit_disturbance_type(rows: DataFrame, edges: DataFrame, **options) -> mixedmodel.FittedModel:
    """Slope on log age, log height and disturbance type, regions spatially structured."""
    data = materialize(rows.select("region", "Disturbance_Type", "error", "y", "log_age",
                                   "log_height"))
    inside = spatial.checked_edges(edges, spatial.regions_in(data))
    return mixedmodel.fit_region_model(data, inside, ["log_age", "log_height"],
                                       "Disturbance_Type", BASE_LEVEL, **options)


def fit_time_since(rows: DataFrame, edges: DataFrame, **options) -> mixedmodel.FittedModel:
    """Slope on time since disturbance and its type, with a plot intercept.

    The base level of the disturbance is the alphabetically first one.
    """
    data = materialize(rows.select("FINAL_PLT_ID", "region", "Actual_Dist", "error", "y",
                                   "Time_Since_Dist", "log_age", "log_height"))
    inside = spatial.checked_edges(edges, spatial.regions_in(data))
    return mixedmodel.fit_region_plot_model(
        data, inside, ["Time_Since_Dist", "log_age", "log_height"], "Actual_Dist",
        "Animal Damage/Grazing", **options)
