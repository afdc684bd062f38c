"""Two tokenizers' tokens of the same texts: which overlap, in which groups they meet, and how often pairs do, corpus-wide.

Token ends of both sides are ascending byte offsets. Merging them is cut by merge paths: a binary search on each diagonal
finds how many ends of either side come before a given step, so every piece has the same number of steps and needs nothing
of the others. A piece emits the overlaps that end in it; where an end of both sides falls on a cut, the later piece leaves
to the earlier what both would emit, and running counts of common ends turn the pieces' groups into the whole's.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from ..session import as_table
from .bpe import BYTE_CHARACTERS
from .text import as_bytes, in_blocks, release

# Steps of a merge path's piece, and bytes of text that are encoded together.
PIECE_STEPS, ENCODED_BYTES = 1 << 16, 1 << 20
# Pairs whose counts are broadcast, the most frequent ones; at some 50 bytes each.
BROADCAST_PAIRS = 1 << 20
SPACE = "▁"
# A space between characters that are no white space for either side.
CUT = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")
# A segment that has such a place on both sides of it, within a text.
JOINS = re.compile(r" [!-~\w](.*[!-~\w])?", re.DOTALL)
# Segments that a process keeps the ids of, twice at most, and their length at most.
CACHE_SEGMENTS, KEPT_CHARACTERS = 250_000, 40


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def piece_count(path: str) -> int:
    """The size of a sentencepiece model's vocabulary."""
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


class Tokens:
    """The bytes of a tokenizer's entries by id, and their lengths."""

    def __init__(self, entries: dict[int, bytes]) -> None:
        self.size = max(entries) + 1
        self.bytes = [entries.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def byte_level_entries(model: bytes) -> dict[int, bytes]:
    """Bytes of a byte-level BPE file's entries, its special ones included."""
    back = {c: b for b, c in enumerate(BYTE_CHARACTERS)}
    data = json.loads(model)
    entries = {i: bytes(back[c] for c in t) for t, i in data["model"]["vocab"].items() if all(c in back for c in t)}
    return entries | {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}


def piece_entries(model: sentencepiece.SentencePieceProcessor) -> dict[int, bytes]:
    """Bytes of a sentencepiece model's pieces: the text with U+2581 as a space, or the byte of a byte piece."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return {i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}


class Pair:
    """Both tokenizers. A encodes space + text, B the text, before which it puts the space by itself.

    Neither side's tokens cross a place of CUT: A's pre-tokens begin with the space, and no piece of B has a space after
    another character. So texts are cut there, and a segment that occurs again is encoded once.
    """

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.of_a, self.of_b = Tokens(byte_level_entries(byte_level)), Tokens(piece_entries(self.b))
        self.cuts = not any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.of_b.size))
        # an id's decimal digits after each separator, by separator and id
        ids = range(max(self.of_a.size, self.of_b.size))
        self.written = [sep + b"%d" % i for sep in (b"", b",", b"|", b";") for i in ids]
        self.width = np.array([len(w) for w in self.written], np.int64)
        self.ids = len(ids)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text; none for one that is empty or whose ids don't spell space + text on both sides."""
        plain = [" " + t.decode("utf-8", "replace") for t in texts]
        cut = [CUT.split(t) if self.cuts else [t] for t in plain]
        if len(self.known) > CACHE_SEGMENTS:
            self.known, self.older = {}, self.known
        distinct = set(chain.from_iterable(cut)).difference(self.known)
        found = {s: self.older[s] for s in distinct if s in self.older}
        found |= self.encode_segments([s for s in distinct if s not in found])
        self.known |= {s: ids for s, ids in found.items() if len(s) <= KEPT_CHARACTERS}
        found |= self.known
        a, b = [], []
        for text, segments in zip(texts, cut):
            ids = list(map(found.__getitem__, segments))
            left, right = zip(*ids) if text and None not in ids else ((), ())
            a.append(np.frombuffer(b"".join(left), "<u4"))
            b.append(np.frombuffer(b"".join(right), "<u4"))
        return a, b

    def encode_segments(self, segments: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Packed ids of each segment on both sides; None if either doesn't spell it. Segments begin with a space.

        Those that can follow each other are encoded in one go, as a text, and told apart by their lengths.
        """
        text = [s for s in segments if JOINS.fullmatch(s)]
        whole = "".join(text)
        a, b = self.ids_of(whole)
        if not self.spells(whole, a, b):
            text, whole = [], ""
        ends = np.cumsum([len(s.encode()) for s in text])
        packed = []
        for ids, side in ((a, self.of_a), (b, self.of_b)):
            ids = np.array(ids, "<u4")
            at = np.append(0, np.searchsorted(np.cumsum(side.lengths[ids]), ends) + 1) * 4 if text else np.zeros(1, int)
            data = ids.tobytes()
            packed.append([data[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())])
        found: dict[str, tuple[bytes, bytes] | None] = dict(zip(text, zip(*packed)))
        for segment in segments:
            if segment not in found:
                a, b = self.ids_of(segment)
                found[segment] = (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if self.spells(segment, a, b) else None
        return found

    def ids_of(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])

    def spells(self, text: str, a: list[int], b: list[int]) -> bool:
        return self.of_a.spell(a) == (whole := text.encode()) and self.of_b.spell(b) == whole


@lru_cache(maxsize=1)
def pair_of(byte_level: bytes, pieces: bytes) -> Pair:
    """Kept in the worker process, so that later tasks find the models loaded."""
    return Pair(byte_level, pieces)


def merge_paths(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the merge of two ascending arrays into pieces of ``steps`` elements: how many of each come before the cut.

    Of equal elements, that of ``a`` comes first. All diagonals are searched at once, by halving.
    """
    diagonals = np.arange(0, len(a) + len(b) + steps, steps)
    diagonals[-1] = len(a) + len(b)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # is a[middle] among the first elements? it is if it isn't above the last of b that would be
        ahead = np.zeros(len(diagonals), bool)
        ahead[open_] = a[middle[open_]] <= b[(diagonals - middle - 1)[open_]]
        low, high = np.where(open_ & ahead, middle + 1, low), np.where(open_ & ~ahead, middle, high)
    return low, diagonals - low


@dataclass
class Overlaps:
    """Overlapping tokens (their places on either side) in order, and the ends that both sides share."""

    a: np.ndarray
    b: np.ndarray
    common: np.ndarray


def piece_overlaps(a: np.ndarray, b: np.ndarray, i: int, j: int, before: int) -> Overlaps:
    """Overlaps that end in a piece: ends ``a`` from place ``i`` on and ``b`` from ``j`` on; ``before`` is a's last end earlier.

    Each distinct end closes one stretch of bytes, which lies in one token of either side: the first that ends there or
    later. If b's first end is ``before``, the earlier piece has closed it: only that the end is common is noted here.
    """
    split = int(len(b) > 0 and b[0] == before)
    own = b[split:]
    at_a, at_b = np.searchsorted(own, a), np.searchsorted(a, own)
    shared = np.zeros(len(own), bool)
    inside = at_b < len(a)
    shared[inside] = a[at_b[inside]] == own[inside]
    alone = np.flatnonzero(~shared)  # a shared end is emitted from a's side
    j += split
    left = np.concatenate([np.arange(len(a)), at_b[alone]])
    right = np.concatenate([at_a, alone])
    order = np.lexsort((right, left))
    return Overlaps(left[order] + i, right[order] + j, np.concatenate([b[:split], own[shared]]))


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> Overlaps:
    """All overlaps of tokens with ascending ends ``a`` and ``b``, whose last ends are equal."""
    i, j = merge_paths(a, b, steps)
    parts = [piece_overlaps(a[i[p]:i[p + 1]], b[j[p]:j[p + 1]], int(i[p]), int(j[p]), int(a[i[p] - 1]) if i[p] else -1)
             for p in range(len(i) - 1)]
    none = np.empty(0, np.int64)
    return Overlaps(*(np.concatenate([none, *(getattr(p, name) for p in parts)]) for name in ("a", "b", "common")))


def align_block(pair: Pair, texts: list[bytes]) -> list[pa.Array]:
    """Of each text: n_a, n_b, n_groups, n_links, groups, pairs and times. All texts' tokens are merged as one sequence."""
    ids_a, ids_b = pair.encode(texts)
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(pair.of_a.lengths[a]), np.cumsum(pair.of_b.lengths[b])
    met = overlaps(end_a, end_b)
    doc_a, doc_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    text_ends = np.cumsum(np.array([len(t) + 1 if n else 0 for t, n in zip(texts, n_a.tolist())], np.int64))
    n_groups = np.diff(np.searchsorted(met.common, text_ends, "right"), prepend=0)
    n_links = np.bincount(doc_a[met.a], minlength=len(texts))

    # written form: a group's tokens of A, then of B; a group ends with the end that both share
    group_a, group_b = np.searchsorted(met.common, end_a), np.searchsorted(met.common, end_b)
    until_a, until_b = (np.searchsorted(ends, met.common, "right") for ends in (end_a, end_b))
    codes = np.empty(len(a) + len(b), np.int64)
    new_a, new_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
    first = np.diff(doc_a, prepend=-1) > 0
    place_a = np.arange(len(a)) + np.concatenate([[0], until_b])[group_a]
    place_b = np.arange(len(b)) + until_a[group_b]
    codes[place_a] = np.where(first, 0, np.where(new_a, 3, 1)) * pair.ids + a
    codes[place_b] = np.where(new_b, 2, 1) * pair.ids + b
    whole = b"".join(map(pair.written.__getitem__, codes.tolist()))
    offsets = np.concatenate([[0], np.cumsum(pair.width[codes])])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    groups = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole)).cast(pa.string())

    key = doc_a[met.a] * (pair.of_a.size * pair.of_b.size) + a[met.a] * pair.of_b.size + b[met.b]
    keys, times = np.unique(key, return_counts=True)
    bounds = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * (pair.of_a.size * pair.of_b.size)), pa.int32())
    pairs = pa.ListArray.from_arrays(bounds, pa.array(keys % (pair.of_a.size * pair.of_b.size), pa.int64()))
    return [*(pa.array(n.astype(np.int64)) for n in (n_a, n_b, n_groups, n_links)), groups, pairs,
            pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))]


def align(docs: DataFrame, byte_level_path: str, piece_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times. One pass over the texts, no shuffle.

    A is the byte-level BPE of ``byte_level_path`` on space + text, B the sentencepiece model of ``piece_path`` on the
    text, both without special tokens: strings of special tokens in a text are plain text. A link is a token of A and
    one of B whose byte ranges overlap. Byte offsets where tokens of both end cut the tokens into groups, ``groups``:
    A's ids, a bar, B's ids, groups joined by semicolons. ``pairs`` are the distinct pairs of linked ids, A's times the
    size of B's vocabulary plus B's, ascending, and ``times`` how many links of the text each stands for.

    A text that is null or empty, or that either side's tokens don't spell, has no tokens: zeros, an empty string, empty
    lists. Rows of one doc_id are rows like others. An empty table gives none. Other columns are not read.

    A text costs memory in proportion to its length when it is encoded; merging goes by pieces of PIECE_STEPS.
    """
    models = docs.sparkSession.sparkContext.broadcast((read_bytes(byte_level_path), read_bytes(piece_path)))
    columns = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = StructType([columns.schema["doc_id"], *(StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
                         StructField("groups", StringType()), StructField("pairs", ArrayType(LongType())),
                         StructField("times", ArrayType(IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*models.value)
        for batch in batches:
            texts, at = as_bytes(batch.column(1)), 0
            for part in in_blocks(batch, [len(t) for t in texts], ENCODED_BYTES):
                made = align_block(pair, texts[at:at + part.num_rows])
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), *made], schema.names)
        release()

    return columns.mapInArrow(run, schema)


def count_links(aligned: DataFrame, pieces: int) -> DataFrame:
    """``aligned`` (of :func:`align`; ``pieces`` is the size of B's vocabulary) with ``n_best`` and ``count_sum``.

    A pair's count is how many rows of ``aligned`` hold it. ``count_sum`` is the sum over a row's links, ``n_best`` how
    many links have the highest count of their A id, ties included. ``pairs`` and ``times`` are dropped.

    Pairs are counted within tasks, then shuffled. The BROADCAST_PAIRS most frequent, or fewer, are broadcast to the rows;
    what other pairs a row has is shuffled to their counts. A pair that is not broadcast is held by at most two in
    BROADCAST_PAIRS of all that are counted, so no key of that shuffle is hot.
    """
    rows = as_table(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    held = rows.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair"})
    counts = as_table(held.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    counts = counts.withColumn("a", F.expr(f"pair div {pieces}"))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    scored = as_table(counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-scores")

    # the lowest power of two that few enough pairs reach
    sizes = scored.groupBy(F.expr("length(bin(n)) - 1").alias("power")).agg(F.count(F.lit(1)).alias("pairs"))
    least, total, left = 64, 0, False
    for r in sorted(sizes.collect(), reverse=True):
        if left := total + r.pairs > BROADCAST_PAIRS:
            break
        least, total = r.power, total + r.pairs
    frequent = F.expr(f"length(bin(n)) > {least}")
    links = held.join(F.broadcast(scored.where(frequent)), "pair", "left" if left else "inner")
    met = links.where("n IS NOT NULL")
    if left:
        rare = links.where("n IS NULL").select("_row", "pair", "times")
        met = met.unionByName(rare.join(scored.where(~frequent), "pair"))
    sums = met.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "_row", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("n_best", "count_sum")}).drop("_row")
