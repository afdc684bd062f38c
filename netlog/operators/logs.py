"""JSON payloads to documents: strict parse with a reject reason, field access, flattening, printing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.barrier import compute_once
from ..functions.documents import has_infinite_number, has_lone_surrogate, is_json_object_text, strict_json
from ..schemas import MAX_JSON_BYTES


def parse_logs(df: DataFrame, col: str = "data", *, max_bytes: int = MAX_JSON_BYTES) -> DataFrame:
    """Add ``doc`` (VARIANT object) and ``reject_reason`` (``empty``, ``too_large``, ``bad_json`` or what it was).

    ``col`` is BINARY or STRING. Each accepted row is parsed once; rejected rows keep their place with a NULL ``doc``.
    The session must allow repeated keys (see ``netlog.configure``), of which the last one counts.
    """
    if df.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys") != "true":
        raise ValueError("set spark.sql.variant.allowDuplicateKeys=true, for example with netlog.configure(spark)")
    prior = F.col("reject_reason") if "reject_reason" in df.columns else F.lit(None).cast("string")
    size = F.octet_length(col)
    text = F.col(col).cast("string")
    guard = (
        F.when(prior.isNotNull(), prior)
        .when(F.col(col).isNull() | (size == 0), "empty")
        .when(size > max_bytes, "too_large")
        .when(~F.is_valid_utf8(text), "bad_json")
        .when(~is_json_object_text(text) | has_lone_surrogate(text) | has_infinite_number(text), "bad_json")
    )
    wrapped, read = strict_json(text)
    guarded = df.withColumn("_guard", guard)
    parsed = guarded.withColumn("_parsed", F.when(F.col("_guard").isNull(), wrapped))
    valid, doc = read(F.col("_parsed"))
    reason = F.when(F.col("_guard").isNull() & ~valid, "bad_json").otherwise(F.col("_guard"))
    return compute_once(parsed, {"doc": doc, "reject_reason": reason}).drop("_guard", "_parsed")


def field(name: str, data_type: str = "string", *, doc: str = "doc") -> Column:
    """Top-level field of the document as ``data_type``; NULL when absent or of another type.

    A variant path cannot name an empty key or one with both kinds of quotes; read those through ``flatten``.
    """
    if not name or ("'" in name and '"' in name):
        raise ValueError(f"no variant path names the key {name!r}; use flatten")
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(doc, f"$[{quote}{name}{quote}]", data_type)


def with_fields(df: DataFrame, fields: dict[str, str], *, doc: str = "doc") -> DataFrame:
    """Add several top-level fields as columns: ``{"event": "string", "user_id": "bigint"}``."""
    return df.withColumns({name: field(name, data_type, doc=doc) for name, data_type in fields.items()})


def flatten(df: DataFrame, *, doc: str = "doc") -> DataFrame:
    """One row per top-level field, with ``key`` and ``value`` (VARIANT). Rows without a document give none."""
    spark = df.sparkSession
    return df.lateralJoin(spark.tvf.variant_explode(F.col(doc).outer())).drop("pos")


def to_line(doc: str = "doc") -> Column:
    """The document as one line of JSON, keys sorted."""
    return F.to_json(doc)


def candidates(df: DataFrame, col: str = "payload") -> DataFrame:
    """Rows whose first byte opens an object or array. A pre-filter to ask for: it skips no white space."""
    data = F.col(col)
    if isinstance(df.schema[col].dataType, T.BinaryType):
        return df.where(F.substring(data, 1, 1).isin(F.lit(b"{"), F.lit(b"[")))
    return df.where(F.substring(data, 1, 1).isin("{", "["))
