"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foliotab")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master, else an error:
    executors on other machines would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("foliotab.scratch", None) or _local_scratch(spark)


def _local_scratch(spark: SparkSession) -> str:
    path = tempfile.mkdtemp(prefix="foliotab-", dir=os.environ.get("TMPDIR"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("foliotab.scratch", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; every run gets its own."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder: columnar, computed once, safe from the loss of executors.

    A column without a type cannot be written to a table; such rows take a reliable checkpoint instead.
    """
    spark = df.sparkSession
    if "void" in df.schema.simpleString():
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(shared_dir(spark))
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_by_value(module: str) -> None:
    """Python functions of the module travel inside the task, so executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


