"""Line dedup: a suffix array over the documents' line ids, by distributed prefix doubling, shows repeated line runs.

DataFrame functions only. Suffixes of all documents' line sequences are ranked by their first line, then by prefixes
twice as long, until the prefixes have the length that counts. Suffixes of equal rank are an interval of the array with
a common prefix of that length. A suffix whose prefix occurs once is told apart from all others and leaves the array, so
only repeats are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import as_table
from .text import word_count

# A repeated run counts if it has so many lines, or if a single line has so many words.
MIN_LINES, MIN_WORDS = 2, 50
# Leading bits of a line's hash by which first ranks are summed, and ranks that are summed together later.
HASH_BITS, RANKS = 16, 20

DOC = ["doc", "version"]
PLACE = ["doc", "version", "pos"]


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, version, pos, h1, h2, long): one row per line; ``version`` tells texts of one id apart."""
    lines = docs.select(
        F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"),
        F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("pos", "line"))
    return lines.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                        (word_count(F.col("line")) >= MIN_WORDS).alias("long")).distinct()


def before(total: str, keys: list[str], order: list[str]) -> Column:
    """The sum of ``total`` over the rows before this one."""
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum(total).over(window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def first_ranks(lines: DataFrame) -> DataFrame:
    """(doc, version, pos, long, rank, first) of lines that occur more than once, ranked by their id.

    A rank is the number of suffixes that sort before. Sums run within buckets of the hash's leading bits, then over
    the buckets, of which there are 2 ** HASH_BITS at most.
    """
    distinct = lines.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
    distinct = distinct.withColumn("bucket", F.shiftright("h1", 64 - HASH_BITS))
    buckets = distinct.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", before("n", [], ["bucket"]).alias("base"))
    ranked = distinct.withColumn("inner", before("n", ["bucket"], ["h1", "h2"])).join(F.broadcast(buckets), "bucket")
    ranked = ranked.select("h1", "h2", (F.col("base") + F.col("inner")).alias("rank"), "first")
    return lines.join(ranked, ["h1", "h2"]).select(*PLACE, "long", "rank", "first")


def doubled(suffixes: DataFrame, step: int) -> DataFrame:
    """Suffixes that share a longer prefix with another: their rank, and the rank ``step`` lines on, make the new rank.

    ``step`` is at most the length that the ranks cover. New rank = old rank + suffixes of the same old rank whose
    second rank is smaller. These are counted once per pair of ranks, in ranges of the second rank, so a line with very
    many different followers is no single sorted run.
    """
    on = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(step, step)
    pairs = suffixes.select(*PLACE, "long", "rank", F.first("rank").over(on).alias("then")).where("then IS NOT NULL")
    distinct = pairs.groupBy("rank", "then").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
    distinct = distinct.withColumn("range", F.shiftright("then", RANKS))
    ranges = distinct.groupBy("rank", "range").agg(F.sum("n").alias("n")).select(
        "rank", "range", before("n", ["rank"], ["range"]).alias("base"))
    ranked = distinct.withColumn("inner", before("n", ["rank", "range"], ["then"])).join(ranges, ["rank", "range"])
    ranked = ranked.select("rank", "then", (F.col("rank") + F.col("base") + F.col("inner")).alias("new"), "first")
    return pairs.join(ranked, ["rank", "then"]).select(*PLACE, "long", F.col("new").alias("rank"), "first")


def repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(doc, version, runs): per document the maximal stretches (start, end) of lines that repeat an earlier run.

    A run of ``min_lines`` lines, or one line of MIN_WORDS words, repeats if the same lines in the same order begin at
    an earlier place: by doc_id (null first), then by the text's hash, then by line. The first place is never in one.
    """
    suffixes, covered = first_ranks(as_table(line_table(docs, doc_id, text), "lines")), 1
    later = F.struct(*PLACE) > F.col("first")
    suffixes = as_table(suffixes, "suffixes")
    gone = suffixes.where(F.col("long") & later).select(*PLACE, F.col("pos").alias("last"))
    while covered < min_lines:
        step = min(covered, min_lines - covered)
        suffixes, covered = as_table(doubled(suffixes, step), "suffixes"), covered + step
    gone = gone.union(suffixes.where(later).select(*PLACE, (F.col("pos") + (min_lines - 1)).alias("last")))
    # stretches that touch or overlap are one
    reach = F.max("last").over(Window.partitionBy(*DOC).orderBy("pos", "last").rowsBetween(Window.unboundedPreceding, -1))
    starts = gone.withColumn("new", F.coalesce(F.col("pos") > reach + 1, F.lit(True)).cast("int"))
    run = F.sum("new").over(Window.partitionBy(*DOC).orderBy("pos", "last").rowsBetween(Window.unboundedPreceding, 0))
    runs = starts.withColumn("run", run).groupBy(*DOC, "run").agg(F.min("pos").alias("start"), F.max("last").alias("end"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def drop_repeated_runs(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, runs: str = "deleted_runs",
) -> DataFrame:
    """``docs`` without the lines of later copies of repeated runs, and ``runs``, the stretches of lines deleted.

    ``text`` is what is left, its lines joined by a line feed; ``runs`` holds (start, end) by line number from 0, end
    included, in the text as it was. All copies but the first lose a run, also within one document.

    Null texts stay null and have no runs; an empty text is one empty line. A text that loses every line is empty. Rows of
    equal id and text are one document, and change alike; null ids are ids like others. A column that is already called
    ``runs`` is replaced; other columns stay. An empty table gives none.

    Lines are shuffled as hashes; texts only once, to meet their runs. Groups are summed within tasks before they are
    shuffled, and hot lines meet their ranks in joins that split.
    """
    found = repeated_runs(docs, doc_id=doc_id, text=text, min_lines=min_lines).withColumnsRenamed(
        {"doc": "\0doc", "version": "\0version", "runs": "\0runs"})
    body = F.col(f"`{text}`")
    met = docs.drop(runs).join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col("\0doc"))
                               & (F.xxhash64(body) == F.col("\0version")), "left")
    lines, gone = F.split(body, "\n", -1), F.coalesce(F.col("\0runs"), F.array().cast("array<struct<start:int,end:int>>"))

    def kept(i: Column) -> Column:
        """The lines between the runs before and after place i."""
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1)["end"] + 1)
        end = F.coalesce(F.get(gone, i)["start"], F.size(lines))
        return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), kept)), "\n")
    changed = F.when(F.size(gone) > 0, left).otherwise(body)
    columns = [changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != runs]
    return met.select(*columns, gone.alias(runs))
