"""Substring dedup: suffix automata over shards of the corpus; matching statistics give the spans to remove.

The reference of every document is the corpus itself, all documents with smaller ids. Its shards are cut by content, so
that a document meets the one shard that can hold a span of it, not every shard: each window of words belongs to the
smallest of its 5-gram hashes, its anchor. The windows of one anchor, with the text that they cover, are a shard, and
its automaton is built where the shard is. So nothing that grows with the corpus is broadcast, and work grows with it
in proportion.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType,
)

from ..operators.sizes import broadcast_if_small
from ..session import as_table
from .text import as_bytes, hash_words, in_blocks, map_blocks, mix, rolling

# A span that is removed has this many words at least.
WINDOW = 13
GRAM = 5
# An anchor of more segments than this has its segments summed by content before they meet, and cut finer.
HOT_SEGMENTS = 20_000
# Text of distinct segments that one automaton is built from, some 10^5 words; hot shards of more go window by window.
SHARD_BYTES = 1 << 20
# Bits of the filter of anchors that occur more than once: 16 MB, and as much again for the hot ones. A filter of fixed
# size lets more segments through that match nothing as the corpus grows, never fewer that do.
FILTER_BITS = 27


class SuffixAutomaton:
    """Automaton of several sequences. Each state knows the least document of the sequences it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def add(self, sequence: list, document: int) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            if document < self.least[last]:
                self.least[last] = document

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(1 << 63)
        return len(self.next) - 1

    def _extend(self, last: int, symbol) -> int:
        moves, length, link = self.next, self.length, self.link
        known = moves[last].get(symbol)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, symbol, known)
        state, at = self._state(length[last] + 1, {}, 0), last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at >= 0:
            known = moves[at][symbol]
            link[state] = known if length[known] == length[at] + 1 else self._clone(at, symbol, known)
        return state

    def _clone(self, at: int, symbol, known: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = clone
        while at >= 0 and self.next[at].get(symbol) == known:
            self.next[at][symbol] = clone
            at = self.link[at]
        return clone

    def finish(self) -> None:
        """What occurs in a sequence, occurs wherever the longer states that end with it do."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            if self.least[state] < self.least[above]:
                self.least[above] = self.least[state]

    def least_documents(self, sequence: list, window: int) -> list[int]:
        """For each ``window`` symbols of a sequence in turn, the least document that holds them.

        Matching statistics: the state after each symbol is the longest match that ends there. Links shorten it to the
        state that the last ``window`` symbols belong to.
        """
        out, state = [], 0
        for place, symbol in enumerate(sequence, 1):
            state = self.next[state][symbol]
            if place >= window:
                at = state
                while self.length[self.link[at]] >= window:
                    at = self.link[at]
                out.append(self.least[at])
        return out


def shard_answers(segments: dict[bytes, int], window: int) -> dict[bytes, list[int]]:
    """For each distinct segment of a shard and its least document: the least document of each of its windows."""
    if len(segments) == 1:  # the automaton is one path
        (segment, document), = segments.items()
        return {segment: [document] * (segment.count(b" ") + 2 - window)}
    automaton = SuffixAutomaton()
    split = {segment: segment.split(b" ") for segment in segments}
    for segment, document in segments.items():
        automaton.add(split[segment], document)
    automaton.finish()
    return {segment: automaton.least_documents(words, window) for segment, words in split.items()}


@dataclass
class Runs:
    """Runs of windows with one anchor, of several texts: text, first window, number of windows, and anchor of each."""

    words: list[bytes]
    starts: np.ndarray
    grams: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    size: np.ndarray
    anchor: np.ndarray


def anchor_runs(texts: list[bytes], window: int) -> Runs:
    words: list[bytes] = []
    counts = []
    for text in texts:
        own = text.split()
        words += own
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    grams = rolling(hash_words(words), GRAM)
    n = max(0, len(words) - window + 1)
    least = grams[:n].copy()
    for shift in range(1, window - GRAM + 1):
        np.minimum(least, grams[shift:shift + n], out=least)
    at = np.flatnonzero(np.arange(n) + window <= ends[owner[:n]])
    least, of = least[at], owner[:n][at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
    heads = np.flatnonzero(new)
    return Runs(words, ends - counts, grams, of[heads], at[heads], np.diff(np.append(heads, len(at))), least[heads])


class AnchorFilter:
    """Which anchors occur more than once, and which are hot, by their leading bits: never a wrong no."""

    def __init__(self, table: pa.Table, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.live, self.hot = (np.zeros(1 << (bits - 6), np.int64) for _ in range(2))
        slots = table["slot"].to_numpy()
        self.live[slots], self.hot[slots] = table["live"].to_numpy(), table["hot"].to_numpy()

    def has(self, which: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        place = anchors >> self.shift
        return (which[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) > 0


def finer(runs: Runs, run: int, window: int) -> Iterator[tuple[int, int, int]]:
    """A hot run cut by the second smallest gram too: key, first window, number of windows of each part."""
    first, size = int(runs.first[run]), int(runs.size[run])
    around = np.lib.stride_tricks.sliding_window_view(runs.grams[first:first + size + window - GRAM], window - GRAM + 1)
    rest = np.where(around == runs.anchor[run], np.uint64(0xFFFFFFFFFFFFFFFF), around).min(axis=1)
    heads = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
    keys = mix(rest[heads] ^ mix(runs.anchor[run:run + 1]))
    for key, head, stop in zip(keys.tolist(), heads.tolist(), [*heads[1:].tolist(), size]):
        yield key, first + head, stop - head


def anchor_filter(source: DataFrame, window: int, bits: int) -> pa.Table:
    """(slot, live, hot): 64 bits of the filter each, from counts of all anchors."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_blocks(batch, pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()):
                anchors = anchor_runs(as_bytes(part.column(0)), window).anchor
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64))], ["anchor"])

    counts = source.select("text").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - bits}) & 63 as int))")
    return counts.where("n > 1").groupBy(F.expr(f"shiftrightunsigned(anchor, {64 - bits + 6})").alias("slot")).agg(
        F.bit_or(bit).alias("live"), F.bit_or(F.when(F.col("n") > HOT_SEGMENTS, bit).otherwise(0)).alias("hot")).toArrow()


def segments(source: DataFrame, window: int, bits: int) -> DataFrame:
    """(key, doc, version, start, hot, segment): text of the runs whose anchor may occur elsewhere, first window's place."""
    shared = source.sparkSession.sparkContext.broadcast((anchor_filter(source, window, bits), bits))
    schema = StructType([
        StructField("key", LongType()), StructField("doc", LongType()), StructField("version", IntegerType()),
        StructField("start", IntegerType()), StructField("hot", BooleanType()), StructField("segment", BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = AnchorFilter(*shared.value)
        for batch in batches:
            for part in in_blocks(batch, pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
                runs = anchor_runs(as_bytes(part.column(2)), window)
                live = np.flatnonzero(known.has(known.live, runs.anchor))
                hot = known.has(known.hot, runs.anchor[live])
                keys, owner, first, text, was_hot = [], [], [], [], []
                for r, is_hot in zip(live.tolist(), hot.tolist()):
                    parts = finer(runs, r, window) if is_hot else (
                        (int(runs.anchor[r]), int(runs.first[r]), int(runs.size[r])),)
                    for key, a, size in parts:
                        keys.append(key)
                        owner.append(int(runs.owner[r]))
                        first.append(a)
                        was_hot.append(is_hot)
                        text.append(b" ".join(runs.words[a:a + size + window - 1]))
                rows = np.array(owner, np.int64)
                start = np.array(first, np.int64) - runs.starts[rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(keys, np.uint64).view(np.int64)), part.column(0).take(pa.array(rows)),
                    part.column(1).take(pa.array(rows)), pa.array(start.astype(np.int32)), pa.array(was_hot, pa.bool_()),
                    pa.array(text, pa.binary())], [f.name for f in schema])

    return source.where("doc IS NOT NULL").select("doc", "version", "text").mapInArrow(run, schema)


def column_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows by their first column, which they are sorted by; a group is held no longer than it is read."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    yield from groupby(rows, key=lambda row: row[0])


def by_shard_size(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments whose key has SHARD_BYTES of text at most, and the others; of the latter's keys there are few."""
    sizes = distinct.groupBy("key").agg(F.sum(F.octet_length("segment")).alias("bytes"))
    large = broadcast_if_small(as_table(sizes.where(F.col("bytes") > SHARD_BYTES).select("key"), "substrings-large"))
    return distinct.join(large, "key", "left_anti"), distinct.join(large, "key", "left_semi")


def window_answers(distinct: DataFrame, window: int) -> DataFrame:
    """(key, segment, least) as of an automaton, from a least document per distinct window, summed within tasks first."""
    schema = StructType([StructField("id", LongType()), StructField("place", IntegerType()),
                         StructField("words", BinaryType()), StructField("doc", LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for number, segment, doc in zip(*(c.to_pylist() for c in batch.columns)):
                words = segment.split(b" ")
                for i in range(len(words) - window + 1):
                    out.append((number, i, b" ".join(words[i:i + window]), doc))
                    if len(out) == 10_000:
                        yield as_batch(out, schema)
                        out = []
        yield as_batch(out, schema)

    each = distinct.select("id", "segment", "doc").mapInArrow(run, schema)
    least = each.groupBy("words").agg(F.min("doc").alias("least"))
    placed = each.select("id", "place", "words").join(least, "words").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("place", "least"))).alias("found"))
    return distinct.join(placed, "id").select("key", "segment", F.col("found.least").alias("least"))


def repeated_windows(source: DataFrame, window: int, bits: int) -> DataFrame:
    """(doc, version, windows): the first words of each document's windows that a smaller document holds, as (start, n)."""
    found = as_table(segments(source, window, bits), "substrings")
    spans = StructType([StructField("doc", LongType()), StructField("version", IntegerType()),
                        StructField("start", IntegerType()), StructField("n", IntegerType())])

    def later(start: int, document: int, least: list[int]) -> Iterator[tuple[int, int]]:
        """Runs of windows whose least document is smaller."""
        at = 0
        for smaller, run in groupby(least, key=lambda x: x < document):
            size = len(list(run))
            if smaller:
                yield start + at, size
            at += size

    def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in column_groups(batches):
            group = list(rows)  # HOT_SEGMENTS at most, some 10 MB
            least: dict[bytes, int] = {}
            for _, doc, _, _, segment in group:
                if doc < least.get(segment, 1 << 63):
                    least[segment] = doc
            if len(group) > 1:
                answers = shard_answers(least, window)
                for _, doc, version, start, segment in group:
                    out += [(doc, version, a, n) for a, n in later(start, doc, answers[segment])]
            if len(out) > 50_000:
                yield as_batch(out, spans)
                out = []
        yield as_batch(out, spans)

    keyed = found.where("NOT hot").select("key", "doc", "version", "start", "segment")
    few = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(plain, spans)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in column_groups(batches):
            answers = shard_answers({segment: doc for _, segment, doc in rows}, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(answers), pa.int64()), pa.array(list(answers), pa.binary()),
                 pa.array(list(answers.values()), pa.list_(pa.int64()))], ["key", "segment", "least"])

    hot = found.where("hot")
    distinct = as_table(hot.groupBy("key", "segment").agg(F.min("doc").alias("doc")).select(
        F.monotonically_increasing_id().alias("id"), "key", "segment", "doc"), "shards")
    small, large = by_shard_size(distinct)
    answers = small.select("key", "segment", "doc").repartition("key").sortWithinPartitions("key").mapInArrow(
        summed, StructType([StructField("key", LongType()), StructField("segment", BinaryType()),
                            StructField("least", ArrayType(LongType()))]))
    many = hot.join(answers.union(window_answers(large, window)), ["key", "segment"]).select("doc", "version", F.explode(F.expr(
        "transform(filter(sequence(0, size(least) - 1), i -> least[i] < doc), i -> start + i)")).alias("start"),
        F.lit(1).alias("n"))
    return few.union(many).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "n")).alias("windows"))


def as_batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    types = {LongType(): pa.int64(), IntegerType(): pa.int32(), BinaryType(): pa.binary()}
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[f.dataType]) for c, f in zip(columns, schema)], [f.name for f in schema])


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, ``kept`` (binary) and ``spans`` (start, end) removed, in words.

    A word goes if it is in ``window`` consecutive words of its document that also stand, in this order, in a document
    with a smaller doc_id; windows are judged on the texts as they came in. ``kept`` is what is left, joined by one
    blank; the end of a span is exclusive. Words are cut at the six ASCII blanks.

    Anchors are counted first; segments whose anchor occurs once can't repeat and stay where they are. The others meet
    by anchor, and an automaton over each anchor's distinct segments gives every window's least document. Anchors of
    more than HOT_SEGMENTS segments are summed by content within tasks before they are shuffled, and the answers join
    back. If a hot anchor's distinct segments are still more than SHARD_BYTES, as those are in which many documents enter
    a shared passage from contexts of their own, each of their windows is summed by itself and no automaton is built.
    Texts are shuffled once, to meet their spans. Memory: up to HOT_SEGMENTS segments of an anchor, or SHARD_BYTES of hot
    ones.

    Null and empty texts have no words. Rows with a null doc_id lose nothing and are no reference. Rows of equal id are
    no reference for each other. Other columns are not read. An empty table gives none.
    """
    body = F.col(f"`{text}`").cast("binary")
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.hash(body).alias("version"), body.alias("text"))
    found = repeated_windows(source, window, filter_bits)
    key = StructField("doc_id", LongType())
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([key, StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept", BinaryType()), StructField("spans", ArrayType(span))])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, kept, spans = [], [], [], []
        for value, windows in zip(as_bytes(batch.column("text")), batch.column("windows").to_pylist()):
            words = value.split()
            counts.append(len(words))
            edges = np.zeros(len(words) + 1, np.int64)
            for w in windows or ():
                edges[w["start"]] += 1
                edges[w["start"] + w["n"] + window - 1] -= 1
            gone = np.cumsum(edges)[:-1] > 0
            removed.append(int(gone.sum()))
            flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"start": a, "end": b} for a, b in zip(flips[::2].tolist(), flips[1::2].tolist())])
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if len(flips) else words))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()),
             pa.array(spans, spans_type)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    met = source.join(found, ["doc", "version"], "left")
    return map_blocks(met, {c: F.col(c) for c in ("doc", "text", "windows")}, block, schema, "text")
