"""Invertible Bloom lookup sketches over a text's hashed paragraphs, and the difference of two versions by peeling."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from .text import BLOCK_BYTES, as_bytes, hash_words, mix

# A paragraph ends after a line, and within a line after a word whose hash has these bits clear: 4 words on average.
# Ends depend on nothing but the words, so an edit changes the paragraphs that it touches and no others.
END_MASK = np.uint64(3)
# Cells of the sketch that is the fingerprint, and how much larger later retries are. Each digest is in HASHES cells.
CELLS, GROWTH, HASHES = 16, 4, 3
# Cells a digest beyond which only digests that share all their cells can fail.
SPARE = 64
# Bits of a paragraph's digest. Block sizes keep the number of texts below what is left of 64.
DIGEST_BITS = 44


class Digests:
    """Paragraph digests of several texts: those of text ``i`` are ``values[bounds[i]:bounds[i + 1]]``.

    A paragraph that a text repeats has a digest for each time, by its turn, so repeats count.
    """

    def __init__(self, texts: list[bytes]) -> None:
        words, counts, breaks = [], [], []
        for text in texts:
            found = 0
            for line in text.split(b"\n"):
                part = line.split()
                words += part
                found += len(part)
                if part:
                    breaks.append(len(words) - 1)
            counts.append(found)
        hashes = hash_words(words)
        owner = np.repeat(np.arange(len(texts)), counts)
        ends = (mix(hashes) & END_MASK) == 0
        ends[breaks] = True
        first = np.flatnonzero(np.concatenate([[True], ends[:-1]])) if len(hashes) else np.empty(0, np.int64)
        group = np.cumsum(np.concatenate([[0], ends[:-1]])) if len(hashes) else np.empty(0, np.int64)
        place = (np.arange(len(hashes)) - first[group]).astype(np.uint64) if len(hashes) else np.empty(0, np.uint64)
        mixed = mix(hashes + place * np.uint64(0x9E3779B97F4A7C15))
        values = mix(np.add.reduceat(mixed, first)) if len(first) else np.empty(0, np.uint64)
        owners = owner[first] if len(first) else np.empty(0, np.int64)
        # text and digest in one number, so that one sort brings the repeats of a text's digest together
        packed = np.sort((owners.astype(np.uint64) << np.uint64(DIGEST_BITS)) | (values >> np.uint64(64 - DIGEST_BITS)))
        index = np.arange(len(packed))
        new = np.ones(len(packed), bool)
        new[1:] = packed[1:] != packed[:-1]
        nth = index - np.maximum.accumulate(np.where(new, index, 0))
        digest = packed & np.uint64((1 << DIGEST_BITS) - 1)
        self.values = mix(digest + (nth.astype(np.uint64) << np.uint64(DIGEST_BITS)))
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(texts)))]).astype(np.int64)

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the texts ``rows``, and for each the place of its text among ``rows``."""
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.values[self.bounds[rows][owner] + inner], owner


class Table:
    """Sketches [owner, cell]: in each cell the number of its digests, and they and their checks summed bit by bit."""

    def __init__(self, counts: np.ndarray, keys: np.ndarray, checks: np.ndarray, cells: int) -> None:
        self.counts, self.keys, self.checks, self.cells = counts, keys, checks, cells

    @classmethod
    def of(cls, keys: np.ndarray, owner: np.ndarray, owners: int, cells: int) -> Table:
        size = owners * cells
        counts, table = np.zeros(size, np.int32), cls(np.empty(0), np.zeros(size, np.uint64), np.zeros(size, np.uint32), cells)
        spots, checks = places(keys, cells)
        for spot in spots:
            at = owner * cells + spot
            counts += np.bincount(at, minlength=size).astype(np.int32)
            np.bitwise_xor.at(table.keys, at, keys)
            np.bitwise_xor.at(table.checks, at, checks)
        table.counts = counts
        return table

    def __sub__(self, other: Table) -> Table:
        return Table(self.counts - other.counts, self.keys ^ other.keys, self.checks ^ other.checks, self.cells)


def places(keys: np.ndarray, cells: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A cell in each of the table's three parts, and a check, for each key."""
    part, low, half = np.uint64(cells // HASHES), np.uint64(0xFFFFFFFF), np.uint64(32)
    one = mix(keys)
    two = mix(one)
    spots = [((x * part) >> half).astype(np.int64) + i * int(part)
             for i, x in enumerate((one >> half, one & low, two >> half))]
    return spots, (two & low).astype(np.uint32)


def peel(table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The digests that only one side has: their owners, values and sides (+1 left), and which owners peeled to nothing.

    All tables are peeled together, round by round: a cell with one digest gives it away, and it leaves its other cells.
    """
    cells, counts, all_keys, all_checks = table.cells, table.counts, table.keys, table.checks
    owners = len(counts) // cells
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(np.abs(counts) == 1)
    budget = np.full(owners, 4 * cells)  # a wrong check could make a table turn round and round
    while len(look):
        look = look[np.abs(counts[look]) == 1]
        keys = all_keys[look]
        spots, checks = places(keys, cells)
        pure = checks == all_checks[look]
        owner = look // cells
        # a digest that is alone in several cells leaves once: from the first of them
        for i, spot in enumerate(spots[:-1]):
            here = owner * cells + spot
            alone = (np.abs(counts[here]) == 1) & (all_keys[here] == keys)
            pure &= ~alone | (look <= here)
        if not pure.any():
            break
        owner, keys, checks, side = owner[pure], keys[pure], checks[pure], counts[look[pure]]
        budget -= np.bincount(owner, minlength=owners)
        going = budget[owner] >= 0
        owner, keys, checks, side = owner[going], keys[going], checks[going], side[going]
        found.append((owner, keys, side))
        touched = [owner * cells + spot[pure][going] for spot in spots]
        for at in touched:
            np.subtract.at(counts, at, side)
            np.bitwise_xor.at(all_keys, at, keys)
            np.bitwise_xor.at(all_checks, at, checks)
        look = np.unique(np.concatenate(touched))
    left = (counts != 0) | (all_keys != 0) | (all_checks != 0)
    clear = ~left.reshape(owners, cells).any(axis=1)
    parts = [np.concatenate(x) for x in zip(*found)] if found else [
        np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)]
    return parts[0], parts[1], parts[2], clear


def size_class(digests: np.ndarray) -> np.ndarray:
    """Cells for about so many digests: a power of two, made a multiple of HASHES, CELLS at least."""
    bits = np.ceil(np.log2(np.maximum(digests, CELLS))).astype(np.int64)
    return (1 << bits) // HASHES * HASHES


def likeness(left: Digests, rows_left: np.ndarray, right: Digests, rows_right: np.ndarray) -> np.ndarray:
    """1 less the differing digests' share of both sides', for pairs of texts. Two texts without paragraphs are alike.

    The fingerprints are subtracted and peeled. A pair that doesn't peel is tried again with sketches of half as many
    cells as both texts have digests, then with GROWTH times as many, and so on. A pair whose sketch is SPARE times
    larger than both texts and still doesn't peel (two digests share all cells) is compared directly.
    """
    n_left, n_right = left.sizes()[rows_left], right.sizes()[rows_right]
    both = n_left + n_right
    differ = np.zeros(len(rows_left), np.int64)
    cells = size_class(np.full(len(both), CELLS))
    # no more digests can be peeled than there are cells: where the numbers alone differ by more, it is no use to try
    cells = np.where(np.abs(n_left - n_right) > cells, size_class(both / 2), cells)
    waiting = np.flatnonzero(both > 0)
    while len(waiting):
        later = []
        for size in np.unique(cells[waiting]).tolist():
            now = waiting[cells[waiting] == size]
            lk, lo = left.take(rows_left[now])
            rk, ro = right.take(rows_right[now])
            owner, _, _, clear = peel(Table.of(lk, lo, len(now), size) - Table.of(rk, ro, len(now), size))
            differ[now] = np.bincount(owner, minlength=len(now))
            stuck = now[~clear]
            hopeless = size > SPARE * np.maximum(both[stuck], CELLS)
            for i in stuck[hopeless]:
                a, b = left.take(rows_left[[i]])[0], right.take(rows_right[[i]])[0]
                differ[i] = len(np.setxor1d(a, b))
            stuck = stuck[~hopeless]
            cells[stuck] = np.where(size < size_class(both[stuck] / 2), size_class(both[stuck] / 2),
                                    size_class(np.full(len(stuck), size * GROWTH)))
            later.append(stuck)
        waiting = np.sort(np.concatenate(later))
    return np.where(both > 0, 1 - differ / np.maximum(both, 1), 1.0)


def as_text(digests: Digests) -> list[str]:
    """A fingerprint per text: the number of digests, and the cells of the smallest sketch."""
    sizes = digests.sizes()
    keys, owner = digests.take(np.arange(len(sizes)))
    cells = int(size_class(np.array([CELLS]))[0])
    table = Table.of(keys, owner, len(sizes), cells)
    rows = np.empty((len(sizes), cells), [("count", "<i4"), ("keys", "<u8"), ("checks", "<u4")])
    for name, values in (("count", table.counts), ("keys", table.keys), ("checks", table.checks)):
        rows[name] = values.reshape(len(sizes), cells)
    return [f"{n:x}:{base64.b64encode(cells.tobytes()).decode()}" for n, cells in zip(sizes.tolist(), rows)]


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following`` as there is."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def with_following(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (part, copy, doc_id, text) dealt by ranges of doc_id, each range followed by a copy of what comes after it.

    Range bounds are about evenly spaced quantiles of the ids, one for each shuffle partition. The driver holds these
    bounds and the smallest id of each range, never texts. The last range is followed by the first row of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    ids = rows.select("doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.lit(0)
    if cuts:
        # ids up to a cut are before it; nulls come first
        part = F.coalesce(F.expr(f"array_size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c < doc_id))"), part)
    heads = ids.withColumn("part", part).groupBy("part").agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("part").collect()
    before = [(h.first if not h.nulls else None, heads[i - 1].part) for i, h in enumerate(heads)]
    dealt = rows.withColumn("part", part).withColumn("copy", F.lit(False))
    if not before:
        return dealt.select("part", "copy", "doc_id", "text")
    start = spark.createDataFrame(before, StructType([docs.select(F.col(f"`{doc_id}`").alias("first")).schema["first"],
                                                      StructField("to", LongType())]))
    copies = rows.join(F.broadcast(start), F.col("doc_id").eqNullSafe(F.col("first"))).select(
        F.col("to").cast("int").alias("part"), F.lit(True).alias("copy"), "doc_id", "text")
    return dealt.select("part", "copy", "doc_id", "text").union(copies)


def fingerprint_versions(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each text and its edited version: the last quarter replaced by the beginning of the next text.

    Returns doc_id, n_chars, edited (binary, UTF-8), fingerprint, edited_fingerprint, and near_edited and near_next, the
    likeness (0 to 1) to the edited version's and the next document's fingerprint. A fingerprint is an invertible Bloom
    lookup sketch of the text's distinct paragraph digests; likeness comes from subtracting two sketches and peeling
    the differing digests, with larger sketches of the same digests where that fails.

    Texts are shuffled once, by ranges of doc_id, and each range also gets the one row that follows it. Within a task
    rows stream by in order, in blocks of bounded size.

    The next document is by ascending doc_id, null first, then by text for repeated ids; after the last comes the first.
    A single document is followed by itself. Null texts are empty; two empty texts are alike (1). Equal texts have equal
    fingerprints. Other columns are not read; an empty table gives none.
    """
    key = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema["doc_id"]
    schema = StructType([
        key, StructField("n_chars", LongType()), StructField("edited", BinaryType()),
        StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
        StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])
    order = ["part", "copy", F.col("doc_id").asc_nulls_first(), "text"]
    dealt = with_following(docs, doc_id, text).repartition("part").sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, kind, done = [], [], 0, None, None

        def flush(last: bool) -> pa.RecordBatch:
            # the last text is only what follows, unless nothing follows
            whole = [t.decode("utf-8", "replace") for t in texts]
            after = whole[1:] if not last else whole[1:] + whole[-1:]
            own = whole[:len(after)]
            changed = [edited(t, f).encode() for t, f in zip(own, after)]
            marks, new = Digests(texts), Digests(changed)
            rows = np.arange(len(own))
            prints = as_text(marks)
            return pa.RecordBatch.from_arrays([
                pa.array(ids[:len(own)], id_type), pa.array([len(t) for t in own], pa.int64()),
                pa.array(changed, pa.binary()), pa.array(prints[:len(own)]), pa.array(as_text(new)),
                pa.array(likeness(marks, rows, new, rows)),
                pa.array(likeness(marks, rows, marks, np.minimum(rows + 1, len(texts) - 1))),
            ], [f.name for f in schema])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            parts, copies, keys, values = (batch.column(i) for i in range(4))
            for part, copy, key_, value in zip(parts.to_pylist(), copies.to_pylist(), keys.to_pylist(), as_bytes(values)):
                if part == done:
                    continue  # further rows of the id that follows
                if texts and kind != part:
                    yield flush(True)
                    ids, texts, held = [], [], 0
                kind = part
                ids.append(key_)
                texts.append(value)
                held += len(value)
                if copy or held > BLOCK_BYTES and len(texts) > 1:
                    if len(texts) > 1:
                        yield flush(False)
                    ids, texts, held = ([], [], 0) if copy else (ids[-1:], texts[-1:], len(texts[-1]))
                    done = part if copy else done
        if texts:
            yield flush(True)

    return dealt.mapInArrow(run, schema)
