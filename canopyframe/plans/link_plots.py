"""Trees and tree identities -> trees with one plot id across surveys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canopyframe.operators import linking


def trees_with_plot_ids(tree: DataFrame, identity: DataFrame, link_after: int = 2001,
                        first_year: int = 2001, fill_singletons: bool = False) -> DataFrame:
    known = linking.identified_trees(tree, identity)
    components = linking.plot_components(known, after_year=link_after)
    return linking.attach_components(known, components, first_year, fill_singletons)
