"""Exact duplicates by progressive refinement: equal lengths, then equal beginnings, then equal hashes of whole texts.

DataFrame functions only. Each step leaves the rows that may still have an equal for the next one. What a step leaves is
told to the next scan by a bit filter of fixed size, so texts are never shuffled, and only rows that pass are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.bitfilter import bit_filter, with_filter
from ..session import as_table
from .hot import join_groups

# Characters that don't count.
BLANKS = " \t\n\v\f\r"
# Characters of a text's beginning that are hashed.
PREFIX = 256
# Bits of the filters of lengths and of beginnings: 512 KB and 16 MB. A full filter lets more rows through, no fewer.
LENGTH_BITS, PREFIX_BITS = 22, 27


def exact_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", every_digest: bool = False,
) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept and ``digest`` (SHA-256, hexadecimal).

    Texts are equal if they are after every blank (BLANKS) is deleted. Of equal texts, the row with the most code points
    in the text as it was stays, then the smallest doc_id (null last), then any one of rows that are alike in all this;
    ``keep_id`` is its doc_id. ``digest`` is that of the text without blanks; it is null for rows that the first two
    steps tell apart from all others, unless ``every_digest`` asks for all.

    1. One scan takes each text's length and a hash of its beginning. Lengths are counted.
    2. Rows whose length occurs again are counted by length and beginning.
    3. A second scan hashes the whole texts of rows whose length and beginning occur again; equal hashes are a group.

    A group's size and the row that stays are found by sums within tasks and one row per group and task shuffled. A group
    of over a thousandth of all rows meets its rows by broadcast, others by a shuffle of narrow rows. Lengths and
    decisions go to written tables, so a lost executor costs no whole scan.

    Null texts count as empty, and all empty or blank texts are one group. Rows of one doc_id are rows like others. An
    empty table gives an empty result. Other columns are not read.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.char_length(body).cast("long").alias("n_chars"),
                       F.translate(body, BLANKS, "").alias("bare"))
    described = bare.withColumns({"length": F.octet_length("bare").cast("long"), "by_length": F.xxhash64(F.octet_length("bare")),
                                  "by_start": F.xxhash64(F.octet_length("bare"), F.left("bare", F.lit(PREFIX)))})

    starts = as_table(described.select("length", "by_length", "by_start"), "exact-starts")
    lengths = starts.groupBy("length", "by_length").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    longs = with_filter(starts, "by_length", bit_filter(lengths, "by_length", LENGTH_BITS), "again", LENGTH_BITS).where("again")
    begun = longs.groupBy("length", "by_start").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    begun = as_table(bit_filter(begun, "by_start", PREFIX_BITS), "exact-filter")

    read = with_filter(described.drop("by_length"), "by_start", begun, "again", PREFIX_BITS)
    whole = F.sha2("bare", 256)
    digest = whole if every_digest else F.when(F.col("again"), whole)
    rows = as_table(read.select("doc_id", "n_chars", "length", "again", digest.alias("digest"),
                                F.monotonically_increasing_id().alias("row")), "exact-rows")

    met = rows.where("again")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = as_table(met.groupBy("length", "digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")),
                      "exact-groups")
    joined = join_groups(met, groups, ["length", "digest"], "group_size", rows.count())
    settled = joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                            (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    alone = rows.where("NOT again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                           F.lit(True).alias("kept"), "digest")
    return settled.unionByName(alone)
