"""Which states and tables exist, and the rules for combining them in one request."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

# State and territory codes, plus the two whole-country bundles.
STATE_CODES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ "
    "NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY AS FM GU MP PW PR VI ENTIRE REF"
).split()

# The 48 contiguous states.
CONTIGUOUS_STATES = (
    "AL AZ AR CA CO CT DE FL GA ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY "
    "NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()

# Table names.
TABLE_NAMES = """
BOUNDARY COND_DWM_CALC COND COUNTY DWM_COARSE_WOODY_DEBRIS DWM_DUFF_LITTER_FUEL
DWM_FINE_WOODY_DEBRIS DWM_MICROPLOT_FUEL DWM_RESIDUAL_PILE DWM_TRANSECT_SEGMENT DWM_VISIT
GRND_CVR INVASIVE_SUBPLOT_SPP LICHEN_LAB LICHEN_PLOT_SUMMARY LICHEN_VISIT OZONE_BIOSITE_SUMMARY
OZONE_PLOT_SUMMARY OZONE_PLOT OZONE_SPECIES_SUMMARY OZONE_VALIDATION OZONE_VISIT
P2VEG_SUBP_STRUCTURE P2VEG_SUBPLOT_SPP PLOT_REGEN PLOT PLOTGEOM PLOTSNAP POP_ESTN_UNIT
POP_EVAL_ATTRIBUTE POP_EVAL_GRP POP_EVAL_TYP POP_EVAL POP_PLOT_STRATUM_ASSGN POP_STRATUM
SEEDLING_REGEN SEEDLING SITETREE SOILS_EROSION SOILS_LAB SOILS_SAMPLE_LOC SOILS_VISIT
SUBP_COND_CHNG_MTRX SUBP_COND SUBPLOT_REGEN SUBPLOT SURVEY TREE_GRM_BEGIN TREE_GRM_COMPONENT
TREE_GRM_ESTN TREE_GRM_MIDPT TREE_REGIONAL_BIOMASS TREE_WOODLAND_STEMS TREE VEG_PLOT_SPECIES
VEG_QUADRAT VEG_SUBPLOT_SPP VEG_SUBPLOT VEG_VISIT CITATION DIFFERENCE_TEST_PER_ACRE
DIFFERENCE_TEST_TOTALS FIADB_VERSION FOREST_TYPE FOREST_TYPE_GROUP GRM_TYPE HABTYP_DESCRIPTION
HABTYP_PUBLICATION INVASIVE_SPECIES LICHEN_SPECIES LICHEN_SPP_COMMENTS NVCS_HEIRARCHY_STRCT
NVCS_LEVEL_1_CODES NVCS_LEVEL_2_CODES NVCS_LEVEL_3_CODES NVCS_LEVEL_4_CODES NVCS_LEVEL_5_CODES
NVCS_LEVEL_6_CODES NVCS_LEVEL_7_CODES NVCS_LEVEL_8_CODES OWNGRPCD PLANT_DICTIONARY POP_ATTRIBUTE
POP_EVAL_TYP_DESCR RESEARCH_STATION SPECIES SPECIES_GROUP STATE_ELEV UNIT
""".split()

# The tables the analysis itself reads.
DEFAULT_TABLES = ("COND", "PLOT", "TREE")


def _upper_unique(values: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(v.upper() for v in values))


def check_states(states: Sequence[str]) -> list[str]:
    """Upper-cased, de-duplicated states; raises for unknown codes and for mixed bundles."""
    wanted = _upper_unique(states)
    if not wanted:
        raise ValueError("no state requested")
    for bundle in ("REF", "ENTIRE"):
        if bundle in wanted and len(wanted) > 1:
            raise ValueError(f"{bundle} cannot be combined with other states")
    unknown = [s for s in states if s.upper() not in STATE_CODES]
    if unknown:
        raise ValueError(f"no data for: {', '.join(unknown)}; use state abbreviations such as AL")
    return wanted


def check_tables(tables: Sequence[str] | None) -> list[str]:
    """Upper-cased, de-duplicated tables; ``None`` stands for the analysis tables."""
    if tables is None:
        return list(DEFAULT_TABLES)
    unknown = [t for t in tables if t.upper() not in TABLE_NAMES]
    if unknown:
        raise ValueError(
            f"unknown tables: {', '.join(unknown)}; give names without a state prefix")
    return _upper_unique(tables)


def file_stems(states: Sequence[str], tables: Sequence[str]) -> dict[str, list[str]]:
    """Table name -> ``<STATE>_<TABLE>`` stems; the ENTIRE bundle carries no prefix."""
    prefixes = [""] if list(states) == ["ENTIRE"] else [f"{s}_" for s in states]
    return {table: [f"{p}{table}" for p in prefixes] for table in tables}
