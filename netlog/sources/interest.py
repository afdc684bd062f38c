"""Port interest list: configuration files, normalisation, and the append-only table of loads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.network import protocol_number
from ..schemas import INTEREST_LOADS

ENTRY = "port: BIGINT, protocol: STRING"


def read_interest(spark: SparkSession, path: str) -> DataFrame:
    """Configuration files as raw entries: ``load_id, loaded_at, port, protocol``.

    A file is YAML (or JSON, which is YAML) with a list ``intercept`` of entries with ``port``, an integer, and
    ``protocol``, a string; other keys pass. A file that is anything else, or that the YAML reader gives up on in any
    way, gives one entry with neither. A file is one load, named by path and modification time. Needs PyYAML where tasks
    run.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.concat_ws("@", "_metadata.file_path", F.unix_micros("_metadata.file_modification_time").cast("string"))
        .alias("load_id"), F.col("_metadata.file_modification_time").alias("loaded_at"), "value",
    )
    entries = F.udf(file_entries, f"ARRAY<STRUCT<{ENTRY}>>")
    return files.select("load_id", "loaded_at", F.inline(entries("value")))


def file_entries(text: str) -> list[tuple[int | None, str | None]]:
    """(port, protocol) of a configuration file, or one pair of nothing for a file that is no such list."""
    import yaml  # not a requirement of the rest of the package

    broken = [(None, None)]
    try:
        listed = yaml.safe_load(text)["intercept"]
        found = [(entry["port"], entry["protocol"]) for entry in listed]
    except Exception:  # dates and tags raise what their constructors raise, deep nesting a RecursionError
        return broken
    if any(type(port) is not int or abs(port) >= 1 << 63 or not isinstance(protocol, str) for port, protocol in found):
        return broken
    return found if isinstance(listed, list) else broken


def normalize_interest(raw: DataFrame) -> DataFrame:
    """Add ``proto`` and ``reject_reason``: ``bad_file``, ``bad_port`` (these fail the load) or ``unsupported_protocol``."""
    reason = (
        F.when(F.col("port").isNull() | F.col("protocol").isNull(), "bad_file")
        .when(~F.col("port").between(0, 65_535), "bad_port")
        .when(F.col("proto").isNull(), "unsupported_protocol")
    )
    return raw.withColumn("proto", protocol_number(F.col("protocol"))).withColumn("reject_reason", reason)


def accepted_loads(normalized: DataFrame) -> DataFrame:
    """The usable entries of the loads that have no bad entry. An unsupported protocol costs only its own entry."""
    failed = normalized.where(F.col("reject_reason").isin("bad_file", "bad_port")).select("load_id").distinct()
    return normalized.where("reject_reason IS NULL").join(failed, "load_id", "left_anti")


def effective_interest(accepted: DataFrame) -> DataFrame:
    """Union of all accepted loads: an entry stays once any load had it."""
    return accepted.groupBy(F.col("port").cast("int").alias("port"), "proto").agg(F.min("loaded_at").alias("loaded_at"))


def append_interest(spark: SparkSession, config_path: str, table_path: str) -> DataFrame:
    """Append the loads not yet in the table and return the effective list.

    A failed load is kept in the table for inspection and changes nothing. If the table is empty and the first load
    fails, this raises, since there is no earlier list to go on with. Configuration is small: this is a driver step.
    """
    loads = normalize_interest(read_interest(spark, config_path)).select(*_load_columns())
    known = read_loads(spark, table_path)
    if known is not None:
        loads = loads.join(known.select("load_id").distinct(), "load_id", "left_anti").select(*_load_columns())
    elif accepted_loads(loads).isEmpty() and not loads.where(
        F.col("reject_reason").isin("bad_file", "bad_port")
    ).isEmpty():
        raise ValueError(f"no usable interest list in {config_path}")
    if not loads.isEmpty():
        loads.write.mode("append").parquet(table_path)
        known = read_loads(spark, table_path)
    return effective_interest(accepted_loads(loads if known is None else known))


def read_loads(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The table of loads, or None if nothing was written yet."""
    try:
        return spark.read.schema(INTEREST_LOADS).parquet(table_path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _load_columns() -> list[str]:
    return ["load_id", "loaded_at", "port", "protocol", "proto", "reject_reason"]
