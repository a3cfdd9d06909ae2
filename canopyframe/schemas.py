"""Declared schemas of the inventory tables. Record keys are text throughout."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {"i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType()}
    fields = []
    for item in spec.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


COND = _schema(
    "STATECD:i UNITCD:i COUNTYCD:i PLOT:i INVYR:i STDORGCD:i STDAGE:d CONDPROP_UNADJ:d "
    "DSTRBCD1:i DSTRBCD2:i DSTRBCD3:i"
)
PLOT = _schema(
    "CN:s INVYR:i STATECD:i UNITCD:i COUNTYCD:i PLOT:i KINDCD:i DESIGNCD:i LON:d LAT:d"
)
TREE = _schema(
    "INVYR:i CN:s PREV_TRE_CN:s PLT_CN:s STATUSCD:i ACTUALHT:d STATECD:i UNITCD:i COUNTYCD:i "
    "PLOT:i SUBP:i SPCD:i DIA:d SPGRPCD:i TPA_UNADJ:d"
)
MACROPLOT = _schema("cn:s")
TREE_IDENTITY = _schema("CN:s FULL_TREE_ID:s")
MORTALITY = _schema("pltID:s YEAR:i PLT_CN:s MORT_PERC:d")
SLOPES = _schema("PLT_CN:s corrected_slope:d se_mean:d sd:d")
PLOT_ATTRIBUTES = _schema(
    "PLT_CN:s STDAGE:d DSTRBCD1:i MAX_HEIGHT:d ECODE_NAME:s FINAL_PLT_ID:s Time_Since_Dist:d"
)
TREATMENT = _schema("PLT_CN:s Treated:s")

BY_TABLE = {"COND": COND, "PLOT": PLOT, "TREE": TREE}
