"""Session settings shared by tests, bench and small runs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC. On a cluster the caller's own session is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postglean")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session that names none gets a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="postglean-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def met(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = 0) -> DataFrame:
    """A join whose right side is broadcast where it has at most ``limit`` rows (counted), else by shuffle and sort.

    The optimizer's guess of a size decides nothing, so a side that grows with the data never reaches the driver.
    """
    small = limit > 0 and right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def tokenizer_dir() -> str:
    """Folder of the public tokenizer files."""
    return os.environ.get("POSTGLEAN_TOKENIZERS", "/opt/tokenizers")
