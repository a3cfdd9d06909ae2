"""Does the year of greatest mortality track the year of disturbance?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.functions.measures import inches_to_cm
from canopyframe.operators import mortality, panel
from canopyframe.operators.listed import only_listed
from canopyframe.session import materialize


def disturbance_and_mortality(trees: DataFrame, mort: DataFrame) -> DataFrame:
    """Visits of plots with a single disturbance, with their mortality history."""
    visits = mortality.visits_with_mortality(mortality.visit_summary(trees),
                                             mortality.mortality_history(mort))
    return mortality.single_disturbance_plots(visits)


def analysis_trees(trees: DataFrame, mort: DataFrame, min_trees: int = panel.MIN_TREES,
                   first_year: int = panel.FIRST_YEAR) -> DataFrame:
    """Measured trees (in cm) of the event visits with enough trees, plots numbered.

    Tree rows are read twice: once to summarise visits, once for the final join. Everything in
    between works on the visit table.
    """
    summary = materialize(mortality.visit_summary(trees, first_year=first_year))
    visits = mortality.visits_with_mortality(summary, mortality.mortality_history(mort))
    events = mortality.matching_event_visits(mortality.single_disturbance_plots(visits))
    candidates = materialize(mortality.event_trees(summary, events))
    sizes = (
        candidates.groupBy(*panel.VISIT_KEYS).agg(F.sum("measured_trees").alias("N_trees"))
        .filter(F.col("N_trees") >= min_trees)
    )
    numbered = sizes.join(panel.number_plots(sizes), on="pltID", how="full")
    wanted = candidates.join(numbered, on=panel.VISIT_KEYS, how="inner").select(
        *panel.VISIT_KEYS, "PLT_CN", "Max_Mort_Year", "Year_of_Disturbance", "N_trees", "Plot_Num")
    wanted = materialize(wanted.dropDuplicates(["INVYR", "PLT_CN", "pltID"]))
    keys = ["INVYR", "PLT_CN", "pltID"]
    # Few visits are events: the others' trees stop at a filter of fixed size, before any shuffle.
    measured = only_listed(panel.measured_trees(trees, first_year=first_year), wanted, keys)
    return measured.join(wanted, on=keys, how="inner").withColumn(
        "DIA", inches_to_cm(F.col("DIA")))
