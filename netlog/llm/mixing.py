"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import as_table

# No source is repeated more often than this.
MAX_REPEATS = 3
# Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
# Rows that are ranked together at most, on average.
CHUNK_ROWS = 50_000
# Leading bits of a size that tell its band apart: sizes in a band differ by less than a thirty-second.
BAND_BITS = 6


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source of ``sizes`` (source, size): ``source_size``, ``n`` rows and ``target``.

    Sources in code point order, null last, have the ``weights`` in turn and share 100% of all sizes by them. No target
    is above ``repeats`` times its source's size; what a source can't take is shared among the others by weight again.
    That ends where a common level L gives every source min(weight * L, cap): sources are full in the order of
    cap / weight, so L follows from running sums. One row per source is ordered; rows are summed per source first.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("_turn", F.row_number().over(by_name) - 1)
    per = per.withColumn("_w", F.element_at(listed, (F.col("_turn") % len(weights) + 1).cast("int")).cast("long"))
    # cap / weight is compared as an integer: the weights' common multiple is divided by the weight
    whole = math.lcm(*weights)
    per = per.withColumn("_cap", F.col("source_size") * repeats)
    per = per.withColumn("_full_at", F.col("_cap") * F.expr(f"{whole} div _w"))
    before = Window.orderBy("_full_at", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    per = (
        per.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        # full: its cap is below its share of what the sources before it leave
        .withColumn("_full", F.col("_cap") * F.col("_weights") < F.col("_w") * F.col("_left"))
    )
    level = per.where("NOT _full").groupBy().agg(
        F.min(F.struct("_full_at", "_turn", "_left", "_weights")).alias("_level"))
    share = (F.col("_w") * F.col("_level._left")).cast("double") / F.col("_level._weights")
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share)
    return per.join(F.broadcast(level)).select("source", "source_size", "n", target.alias("target"))


def systematic_mix(
    docs: DataFrame, size: Column, *, doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS, seed: int = 0,
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target and ``copies``, how often the mix takes the row.

    Every row of a source has the same expected copies r = target / source_size. Rows are laid out by band of size and
    then by a hash of their id, the running sum of r gets one random offset u per source, and a row is taken once for
    each integer that the sum passes at it: floor(r k + u) - floor(r (k - 1) + u) for the k-th row. As similar sizes
    lie together, the taken sizes come near the target; no row is taken more than ``repeats`` times. Offsets and order
    depend on ``seed``, ids and sizes alone, so reruns agree.

    A source's rows are ranked in cells (source, band, slice of the hash) of about CHUNK_ROWS rows at most, however
    many rows a source or a size has; the cells' counts are then added up along the source. Sizes are read once and
    kept in a narrow table in the session's checkpoint folder.

    Null sources are one source, last in order. Null or empty texts have size 0 and are taken like others of their
    source; a source with no words at all has target 0 and takes none. Rows of one id follow each other and are told
    apart by nothing else. An empty table gives an empty result.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"))
    bits = "length(bin(size))"
    keyed = narrow.withColumns({
        "band": F.expr(f"{bits} * {1 << BAND_BITS} + shiftright(size, greatest({bits} - {BAND_BITS}, 0))"),
        "key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))),
    })
    rows = as_table(keyed, "mix-sizes")
    targets = source_targets(rows, weights=weights, repeats=repeats).withColumn(
        "offset", _unit(F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce("source", F.lit("\0null"))))))
    slices = max(1, math.ceil(rows.count() / CHUNK_ROWS))
    rows = rows.withColumn("slice", F.floor(_unit(F.col("key")) * slices))
    cell = ["source", "band", "slice"]
    along = Window.partitionBy("source").orderBy("band", "slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"))
    cells = cells.withColumn("before", F.coalesce(F.sum("rows").over(along), F.lit(0))).drop("rows")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "doc_id")))
    placed = _null_safe(ranked, cells, cell)
    placed = _null_safe(placed, targets, ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = (F.col("before") + F.col("rank")).cast("double")
    copies = F.floor(rate * k + F.col("offset")) - F.floor(rate * (k - 1) + F.col("offset"))
    # at a rate of exactly `repeats`, rounding must not add a copy
    copies = F.least(copies, F.lit(repeats)).cast("int")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def emit_copies(docs: DataFrame, copies: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """``docs``, each row as often as ``copies`` (doc_id, copies) says. Columns stay those of ``docs``.

    Ids are unique as a rule: an id's counts are one short list, and the n-th of its rows is emitted by the n-th count.
    Rows without a count go. Texts are shuffled once, by id.
    """
    def key(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("null"))

    turn = F.row_number().over(Window.partitionBy("_id").orderBy("_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.select("_row", key(F.col("_row")[doc_id]).alias("_id"), F.xxhash64("_row").alias("_hash"))
    counts = copies.groupBy(key(F.col("doc_id")).alias("_id")).agg(F.sort_array(F.collect_list("copies")).alias("_counts"))
    met = rows.withColumn("_turn", turn).join(counts, "_id")
    met = met.withColumn("_times", F.get("_counts", F.col("_turn") - 1)).where("_times > 0")
    return met.select("_row", F.explode(F.sequence(F.lit(1), "_times"))).select("_row.*")


def _unit(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a fraction of one."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, "left").drop(*[f"_r_{k}" for k in keys])
