"""Session, table access and the shared folder that long jobs cut their lineage in."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for local work and tests; on a cluster the submitted configuration wins.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with as many shuffle partitions as cores."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bibliome")
    for key, value in {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only where it names none on a single machine (tests), a temporary
    one. A cluster that names none is an error: other machines couldn't read a local folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "bibliome-checkpoints"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder: later jobs read the files, and a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
