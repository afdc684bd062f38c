"""Phrase collocations by prefix-free parsing: phrases are counted in the distinct chunks of all texts, by how often each is.

Texts are cut into chunks where their content says so: where the hash of a window of words is a multiple of EVERY. A chunk
runs from one such window to the end of the next, so neighbours overlap by one window, equal passages give equal chunks
wherever they stand, and every phrase lies whole in a chunk. The dictionary of distinct chunks and their counts is small
where texts repeat. A phrase counts in the chunk that it starts in, before the closing window; so an overlap counts once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.bitfilter import bit_filter
from ..session import as_table
from .hot import join_groups
from .text import as_bytes, hash_words, in_blocks, mix, release, rolling

# Mean words from one window to the next.
EVERY = 32
MAX_WORDS, LEAST, TOP, INSIDE = 3, 10, 2_000, 50
# Ends of pieces, which no phrase crosses, become line feeds; tabs become spaces.
PIECE_ENDS = b".,;:!?\n\v\f\r"
CUTS = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
NO_LANG = "und"
# Bits of the filter of frequent phrases (16 MB), and bytes of its rows. A full filter lets more through, no fewer.
FREQUENT_BITS, BUCKET_BYTES = 27, 4_096
# Bytes of chunks whose phrases are summed together before they are shuffled.
COUNTED_BYTES = 8 << 20
# Parts in which a language's phrases are ranked before their best are ranked together.
PARTS = 64


@dataclass
class Words:
    """The words of a block of bytes that are cut at spaces and line feeds."""

    data: bytes  # without two spaces one after the other
    start: np.ndarray  # byte where each word starts, and byte after it
    end: np.ndarray
    ids: np.ndarray  # number of each word's entry in ``known``
    known: pa.Array
    piece: np.ndarray  # line feeds before each word

    def phrases(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Words ``first`` to ``last`` (one beyond) of each, which are in one piece."""
        return [self.data[a:b] for a, b in zip(self.start[first].tolist(), self.end[last - 1].tolist())]


def cut_words(data: bytes) -> Words:
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    chars = np.frombuffer(data, np.uint8)
    inside = (chars != 32) & (chars != 10)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(chars[inside])]).dictionary_encode()
    lines = np.zeros(len(start), np.int64)
    after = np.searchsorted(start, np.flatnonzero(chars == 10))
    np.add.at(lines, after[after < len(start)], 1)
    return Words(data, start, end, coded.indices.to_numpy(), coded.dictionary, np.cumsum(lines))


def chunks_of(texts: list[bytes], window: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of all texts' chunks: the number of the text, the words (joined by a space), and how many phrases start in it."""
    data = [t.lower().translate(CUTS) for t in texts]
    words = cut_words(b"\n".join(data))
    count = len(words.ids)
    if not count:
        return np.empty(0, np.int64), [], np.empty(0, np.int64)
    hashes = hash_words(as_bytes(words.known))[words.ids]
    begin = np.ones(count, bool)
    begin[1:] = words.piece[1:] != words.piece[:-1]
    whole = np.flatnonzero(words.piece[:count - window + 1] == words.piece[window - 1:]) if count >= window else []
    begin[whole] |= rolling(hashes, window)[whole] % np.uint64(EVERY) == 0
    first = np.flatnonzero(begin)
    after = np.append(first[1:], count)
    closed = np.zeros(len(first), bool)
    closed[:-1] = words.piece[first[1:]] == words.piece[first[:-1]]
    pieces = np.cumsum([d.count(b"\n") + 1 for d in data])
    of = np.searchsorted(pieces, words.piece[first], "right")
    return of, words.phrases(first, after + np.where(closed, window, 0)), after - first


def summed(counts: DataFrame, *keys: str) -> DataFrame:
    """The sums of ``n``. Blocks are summed already, one row per key, so they are dealt out before they are summed again."""
    return counts.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def parse(docs: DataFrame, window: int) -> DataFrame:
    """(lang, chunk, starts, n) of (lang, text): the dictionary of distinct chunks, and how often each occurs."""
    schema = StructType([StructField("lang", StringType()), StructField("chunk", StringType()),
                         StructField("starts", IntegerType()), StructField("n", LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            at = 0
            for part in in_blocks(batch, [len(t) for t in texts]):
                of, chunks, starts = chunks_of(texts[at:at + part.num_rows], window)
                at += part.num_rows
                made = pa.table({"lang": part.column(0).take(pa.array(of)), "starts": pa.array(starts, pa.int32()),
                                 "chunk": pa.array(chunks, pa.binary())})
                counted = made.group_by(["lang", "chunk", "starts"]).aggregate([([], "count_all")]).combine_chunks()
                for found in counted.to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [found["lang"], found["chunk"].cast(pa.string()), found["starts"], found["count_all"]], schema.names)
        release()

    return as_table(summed(docs.mapInArrow(run, schema), "lang", "chunk", "starts"), "phrase-chunks")


def phrase_hashes(words: Words, lang_of: np.ndarray, size: int) -> np.ndarray:
    """A hash of the language and the ``size`` words at each place, as far as so many follow."""
    rolled = rolling(hash_words(as_bytes(words.known))[words.ids], size)
    return mix(rolled ^ lang_of[words.piece[:len(rolled)]])


def coded_langs(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A column's languages, each row's number among them, and each row's language as a hash."""
    coded = column.combine_chunks().dictionary_encode()
    number = coded.indices.to_numpy()
    return coded.dictionary, number.astype(np.int64), hash_words(as_bytes(coded.dictionary))[number]


def joined_lines(column: pa.ChunkedArray) -> bytes:
    """All values, one a line."""
    values = column.combine_chunks().cast(pa.binary())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b"\n")[0].as_py()


def count_block(rows: pa.Table, size: int, frequent: np.ndarray | None) -> pa.RecordBatch:
    """(lang, phrase, n) of the phrases of ``size`` words that start in the chunks of ``rows``, before their closing windows.

    With ``frequent``, a filter's bits, only those whose first and last ``size - 1`` words are both in it.
    """
    langs, lang, lang_hash = coded_langs(rows["lang"])
    words = cut_words(joined_lines(rows["chunk"]))
    starts, times = rows["starts"].to_numpy(), rows["n"].to_numpy()
    place = np.arange(len(words.ids))
    until = np.searchsorted(words.piece, np.arange(len(starts))) + starts
    live = place[place < until[words.piece]]
    live = live[live + size <= len(place)]
    live = live[words.piece[live + size - 1] == words.piece[live]]
    if frequent is not None and len(live):
        at = phrase_hashes(words, lang_hash, size - 1) % np.uint64(len(frequent) * 8)
        told = frequent[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        live = live[told[live] & told[live + 1]]
    code, most = lang[words.piece[live]], len(langs)
    for i in range(size):  # one number for the language and the words so far
        if most * len(words.known) >= 1 << 62:
            known, code = np.unique(code, return_inverse=True)
            most = len(known)
        code, most = code * len(words.known) + words.ids[live + i], most * len(words.known)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    one = live[order[first]]
    counts = np.add.reduceat(times[words.piece[live[order]]], first) if len(first) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(lang[words.piece[one]])), pa.array(words.phrases(one, one + size), pa.binary()).cast(pa.string()),
         pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def bounded_tables(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The batches, put together to some COUNTED_BYTES of ``column`` each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch[column])).as_py() or 0
        if size >= COUNTED_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def frequent_bits(counts: DataFrame, size: int) -> np.ndarray:
    """The bits of a filter that holds the phrases of ``counts`` (lang, phrase), each of ``size`` words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bounded_tables(batches, "phrase"):
            _, _, lang_hash = coded_langs(rows["lang"])
            words = cut_words(joined_lines(rows["phrase"]))
            made = phrase_hashes(words, lang_hash, size)[::size]
            yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64))], ["h"])
        release()

    rows = bit_filter(counts.select("lang", "phrase").mapInArrow(run, "h long"), "h", FREQUENT_BITS).collect()
    bits = np.zeros((1 << FREQUENT_BITS) // 8, np.uint8)
    for bucket, held in rows:
        start = (bucket - 1) * BUCKET_BYTES
        bits[start:start + BUCKET_BYTES] = np.frombuffer(held, np.uint8)
    return bits


def count_phrases(chunks: DataFrame, size: int, least: int, shorter: DataFrame | None) -> DataFrame:
    """(lang, phrase, n) of the phrases of ``size`` words that occur ``least`` times. Summed per block of chunks first.

    A phrase is no more frequent than its parts: those that ``shorter``, the result for one word less, leaves out are not
    even sent, as far as a filter of fixed size tells.
    """
    bits = chunks.sparkSession.sparkContext.broadcast(None if shorter is None else frequent_bits(shorter, size - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bounded_tables(batches, "chunk"):
            yield count_block(rows, size, bits.value)
        release()

    counted = summed(chunks.select("lang", "chunk", "starts", "n").mapInArrow(run, "lang string, phrase string, n long"), "lang", "phrase")
    return as_table(counted.where(F.col("n") >= least), f"phrase-counts-{size}")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST,
    inside: int = INSIDE, top: int = TOP,
) -> DataFrame:
    """Per language, the ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts are cut at PIECE_ENDS and pieces at spaces and tabs. Candidates are phrases of 2 to
    ``max_words`` words that occur ``a`` >= ``least`` times within pieces, overlaps included. A cut after the first words
    gives the counts ``l`` and ``r`` of both parts and the score floor(10^6 a a / (l r)); the lowest counts, ties to the
    earliest cut. A candidate goes if a longer one that holds it occurs at least ``inside`` percent as often. ``n`` is
    the language's words. Order: score and ``a`` descending, phrase ascending by bytes.

    Counts are integers throughout; scores are formed with 38 digits, and Spark raises an error beyond them (a > 10^15).
    Texts go through one scan; what is shuffled is distinct chunks, then distinct phrases, each summed within tasks. The
    dictionary is read once for each number of words; a phrase is sent if both its parts of a word less are frequent.
    Joins with the parts' counts broadcast fewer than 1,000 frequent parts of each length and shuffle the rest.

    Null and empty texts have no words, a null language is NO_LANG. Repeated rows count as often as they are there. A
    language without candidates has no rows; an empty table has none. Other columns are not read.
    """
    source = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("lang"),
                         F.col(f"`{text}`").cast("binary").alias("text"))
    chunks = parse(source, max_words - 1)
    sizes = chunks.groupBy("lang").agg(F.sum(F.col("starts") * F.col("n")).alias("n_words"))
    counts, by_size = None, None
    for size in range(1, max_words + 1):
        by_size = count_phrases(chunks, size, least, by_size)
        sized = by_size.withColumn("words", F.lit(size))
        counts = sized if counts is None else counts.unionByName(sized)
    total = sizes.agg(F.sum("n_words")).first()[0] or 0

    def part(first: int | str, length: int | str) -> str:
        return f"array_join(slice(split(phrase, ' '), {first}, {length}), ' ')"

    candidates = counts.where("words > 1").withColumnRenamed("n", "a")
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = as_table(cuts.withColumns({"head": F.expr(part(1, "cut")), "rest": F.expr(part("cut + 1", "words - cut"))}),
                    "phrase-cuts")
    parts = counts.where(F.col("words") < max_words)
    left = parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    met = as_table(join_groups(cuts, left, ["lang", "head"], "l", total), "phrase-heads")
    met = join_groups(met, right, ["lang", "rest"], "r", total)
    digits = "decimal(18,0)"
    score = F.expr(f"(cast(a as {digits}) * cast(a as {digits}) * 1000000BD) div (cast(l as {digits}) * cast(r as {digits}))")
    scored = met.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    held = candidates.where("words > 2").select(
        "lang", "phrase", "words", "a", F.explode(F.expr("sequence(2, words - 1)")).alias("length"))
    held = held.withColumn("first", F.explode(F.expr("sequence(1, words - length + 1)")))
    held = held.select("lang", F.expr(part("first", "length")).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left_over = scored.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))

    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase")]
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = left_over.withColumn("part", part_of).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), F.col("n_words").alias("n"),
        F.col("best.score").alias("score"))
