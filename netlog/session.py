"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Every setting here is a runtime SQL setting, so it can be applied to a session that a cluster handed out.
REQUIRED_SETTINGS = {
    # a repeated key keeps its last value, as inserting into a map does; off, Spark rejects the document
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM never compiles a method above 8,000 bytes of bytecode; beyond it, unfused operators are faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on and return the same session."""
    for name, value in REQUIRED_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder for intermediate tables, as the session names it."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """The session's checkpoint folder; on a local master that names none, ``fallback``."""
    folder = checkpoint_dir(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(fallback)
        folder = checkpoint_dir(spark)
    return folder


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and return it as a Parquet table.

    For a result that several steps read: they share one computation, read only their columns, and an executor lost
    later costs no recomputation of what came before. Each call writes a folder of its own; remove it after the job.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the session's file systems; nothing if it is not there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
