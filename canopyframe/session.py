"""Session settings the library relies on, and the one place that cuts lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Skewed joins are left to adaptive execution: it splits the hot partition of the row side and
# re-reads the matching rows of the one-row-per-key side, so no key pins a single task.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where an aggregate after the join would have reused its partitioning: a hot key costs
    # one more shuffle then, everyone else none.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Rounds of an iterative job leave the checkpoint folder once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def with_recommended_conf(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate results, set up on first use.

    Only a session whose executor is the driver itself may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif re.fullmatch(r"local(\[.*\])?", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="canopyframe-"))
    else:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach; "
            "a machine-local folder would not survive the loss of an executor"
        )
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used where a plan must not be evaluated twice with different partition bounds, and between
    the rounds of an iterative job. The copy outlives executors.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
