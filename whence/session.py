"""Session settings, the folder all machines share, and lineage cutting."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Sides that are broadcast by an estimate from their files, in bytes; larger ones are measured first.
ESTIMATED = 256 << 10
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
_MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on.

    Hot keys are left to AQE: it splits skewed join partitions by measured size and
    broadcasts a side only when its measured size allows it.  The forced variant keeps
    the split also where a later grouping on the same key would otherwise suppress it.

    Before anything runs Spark knows a side by the bytes of its compressed files alone, and tokens, intervals and
    keys as text make over a hundred times as much of them.  So the threshold given counts for measured sizes.
    """
    if spark.conf.get(_MEASURED, None) is None:
        given = spark.conf.get(_BROADCAST)
        spark.conf.set(_MEASURED, given)
        if _bytes(given) > ESTIMATED:
            spark.conf.set(_BROADCAST, str(ESTIMATED))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)[a-z]*\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit.replace("b", "") or " ")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    A warehouse in a machine's own file system is refused on a cluster, whose executors would not see it.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/whence-checkpoints"
    if folder.startswith(("file:", "/")) and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"{folder} is a machine's own folder: set spark.checkpoint.dir to one that all machines share")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: later jobs need not make it anew, and may prune it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
