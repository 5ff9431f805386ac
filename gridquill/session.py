"""Session set-up and the two places where an operator needs the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "gridquill", memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are tuned for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> None:
    """Make sure checkpoints have a folder.

    A cluster names it in ``spark.checkpoint.dir``; Spark then sets it itself. Only where the
    setting is absent and the master is local (tests) is a temporary folder taken.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridquill-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(df: DataFrame) -> DataFrame:
    """``df`` for a join in which it grows with the input: never sent through the driver.

    Rows of long texts or arrays, exploded ones most of all, are many times what Spark estimates,
    so its threshold for broadcasts doesn't hold them back.
    """
    return df.hint("merge")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def delivered_once(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table in which a row may be delivered twice, one per ``key``.

    Deliveries differ only in their arrival time, so any of them may stay. The map-side
    partial aggregation of ``dropDuplicates`` keeps a hot key from being shuffled whole.
    """
    return df.dropDuplicates([key])
