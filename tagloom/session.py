"""Session helpers: table access, partition counts and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `data_dir`."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's `spark.checkpoint.dir`; only where none is named (tests) take a folder of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tagloom-checkpoint-", dir=os.environ.get("TMPDIR")))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and drop its lineage (never on local disks)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
