"""Near duplicates by MinHash: many universal hash minima, banding, verification, and components by star contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..operators.sizes import broadcast_if_small
from ..session import as_table
from .text import hash_words, in_blocks, release, rolling

SHINGLE = 5
# Links: 100 times the sets' intersection is at least LINK times their union.
LINK = 75
# 128 minima in 32 bands of 4: a pair at the limit of 0.75 shares no band in 5 of a million cases, one at 0.85 in less
# than 1 of 10^10.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
# Minima that a pair must share to have its sets compared: half. A pair at 0.75 has fewer in 1 of 10^9 cases.
ALIKE = MINIMA // 2
# Rounds in which a bucket's members meet one of them each; what is still apart then is compared block by block.
LEADER_ROUNDS = 3
BLOCK_MEMBERS = 1_024
SEED = 7


def universal(count: int = MINIMA) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of ``count`` hashes x -> (a x + b) mod 2^64, of which the upper 32 bits count."""
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 64, (2, count), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


FACTORS, SUMMANDS = universal()


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sorted distinct shingle hashes of all texts one after another, where each text's begin, and a digest of its words.

    Words are cut at the six ASCII blanks after A-Z are lower-cased. A text of fewer than SHINGLE words has its whole
    sequence as one; one without words has none.
    """
    words, counts, digests = [], [], []
    for text in texts:
        own = text.lower().split()
        words += own
        counts.append(len(own))
        digests.append(hashlib.blake2b(b" ".join(own), digest_size=16).digest())
    hashes, ends = hash_words(words), np.cumsum(counts)
    starts = ends - counts
    rolled = rolling(hashes, SHINGLE)
    sets = []
    for start, end, n in zip(starts.tolist(), ends.tolist(), counts):
        if n >= SHINGLE:
            own = np.sort(rolled[start:end - SHINGLE + 1])
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            sets.append(own[new])
        else:
            sets.append(rolling(hashes[start:end], n) ^ np.uint64(n) if n else np.empty(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), bounds, digests


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima [text, hash] of non-empty sets; rows of empty sets are all ones."""
    out = np.full((len(bounds) - 1, MINIMA), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        starts, hashed = bounds[full], np.empty_like(shingles)
        upper = hashed.view(np.uint32)[1::2] if np.little_endian else hashed.view(np.uint32)[::2]
        for i, (a, b) in enumerate(zip(FACTORS, SUMMANDS)):
            np.multiply(shingles, a, out=hashed)
            hashed += b
            out[full, i] = np.minimum.reduceat(upper, starts)
    return out


def describe(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, ``digest`` of the word sequence, ``n_shingles`` and ``signature`` (binary, MINIMA 32-bit values)."""
    columns = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = StructType([columns.schema["doc_id"], StructField("digest", BinaryType()),
                         StructField("n_shingles", LongType()), StructField("signature", BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            shingles, bounds, digests = shingle_sets([v or b"" for v in part.column(1).to_pylist()])
            made = signatures(shingles, bounds)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(digests, pa.binary()), pa.array(np.diff(bounds)),
                 pa.array([row.tobytes() for row in made], pa.binary())],
                ["doc_id", "digest", "n_shingles", "signature"])

    return columns.mapInArrow(run, schema)


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from in_blocks(batch, [len(v or b"") for v in batch.column(1).to_pylist()])
    release()


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of (doc_id, text): the sorted distinct shingle hashes."""
    schema = StructType([docs.schema["doc_id"], StructField("shingles", ArrayType(LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            shingles, bounds, _ = shingle_sets([v or b"" for v in part.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "shingles"])

    return docs.mapInArrow(run, schema)


def band_keys(signature: Column) -> Column:
    """An array of BANDS hashes, each of the band's number and its ROWS minima."""
    size = 4 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.xxhash64(i, F.substring(signature, i * size + 1, F.lit(size))))


def enough_alike(left: str, right: str) -> Column:
    """Whether two signatures share at least ALIKE minima."""
    def word(side: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(MINIMA - 1)), lambda i: F.substring(side, i * 4 + 1, F.lit(4)))

    return F.size(F.filter(F.zip_with(word(left), word(right), lambda a, b: a == b), lambda same: same)) >= ALIKE


def checked_links(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. Signatures are compared first, then the sets of what remains."""
    signed = reps.select("rep", "signature")
    close = pairs.join(signed.withColumnsRenamed({"rep": "a", "signature": "sig_a"}), "a").join(
        signed.withColumnsRenamed({"rep": "b", "signature": "sig_b"}), "b").where(enough_alike("sig_a", "sig_b"))
    close = as_table(close.select("a", "b"), "minhash-close")
    wanted = close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(broadcast_if_small(wanted), "doc_id", "left_semi")
    sets = as_table(full_sets(texts), "minhash-sets")
    pair = close.join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "set_b"}), "b").join(
        sets.withColumnsRenamed({"doc_id": "a", "shingles": "set_a"}), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pair.where((both > 0) & (both * 100 >= union * LINK)).select("a", "b").distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of it and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its smallest node.

    Large-star and small-star in turn, each round a written table, until the edges stay as they are: then every node
    points at its component. Minima are formed within tasks before they are shuffled, so a node with a great many
    neighbours is no hot group; its edges meet its minimum in a join that splits.
    """
    now, was = as_table(small_star(edges), "star"), None
    while (mark := tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())) != was:
        now, was = as_table(small_star(large_star(now)), "star"), mark
    pointing = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pointing.union(pointing.select(F.col("component").alias("node"), "component")).distinct()


def apart_members(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(band, place, rep, n_shingles, component) of the buckets whose members are not all of one component."""
    if groups is None:
        return members.withColumn("component", F.col("rep"))
    placed = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return as_table(placed.join(split.select("band"), "band"), "minhash-apart")


def block_links(placed: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between members of one bucket and different components, enough of them to connect all that are linked.

    A bucket is cut into parts by hash, and every two parts meet in one group of bounded size. A pass over signatures
    leaves the members that may be linked to another of the group: their minima agree, their set sizes allow it, and
    this is the first band they share. A second pass compares the full sets of these.
    """
    parts = placed.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("parts"))
    cut = placed.join(parts, "band").withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "place", "rep",
                     "n_shingles", "component")
    key = StructType([StructField("group", LongType()), StructField("rep", LongType()), StructField("component", LongType())])

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in sorted_groups(batches):
            marked = may_be_linked(*(list(c) for c in zip(*((r[1:]) for r in rows))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(marked), pa.int64()), pa.array([m[0] for m in marked], pa.int64()),
                 pa.array([m[1] for m in marked], pa.int64())], ["group", "rep", "component"])

    signed = cut.join(reps.select("rep", "signature"), "rep").select(
        "group", "place", "rep", "n_shingles", "component", "signature")
    marked = as_table(signed.repartition("group").sortWithinPartitions("group").mapInArrow(alike, key), "minhash-marked")
    wanted = marked.select(F.col("rep").alias("doc_id")).distinct()
    sets = full_sets(docs.join(broadcast_if_small(wanted), "doc_id", "left_semi")).withColumnRenamed("doc_id", "rep")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches):
            _, reps_, components_, shingles = zip(*rows)
            found = connecting_links(reps_, components_, [np.array(s, np.int64) for s in shingles])
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    full = marked.join(sets, "rep").select("group", "rep", "component", "shingles")
    return full.repartition("group").sortWithinPartitions("group").mapInArrow(verify, "a long, b long")


def sorted_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows by their first column, which they are sorted by."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    yield from groupby(rows, key=lambda row: row[0])


def may_be_linked(places: list[int], reps: list[int], sizes: list[int], components: list[int], signed: list[bytes]) -> list:
    """(rep, component) of a group's members that agree with one of another component in ALIKE minima or more."""
    minima = np.frombuffer(b"".join(signed), np.uint32).reshape(len(signed), BANDS, ROWS)
    size, of, place = np.array(sizes), np.array(components), places[0]
    marked = np.zeros(len(reps), bool)
    step = max(1, (1 << 24) // (MINIMA * len(reps)))
    for start in range(0, len(reps), step):
        rows = slice(start, start + step)
        same = minima[rows, None] == minima[None]
        pair = (of[rows, None] != of[None]) & (np.minimum(size[rows, None], size[None]) * 100
                                               >= np.maximum(size[rows, None], size[None]) * LINK)
        pair &= same.sum(axis=(2, 3)) >= ALIKE
        pair &= ~same[:, :, :place].all(axis=3).any(axis=2)
        marked[rows] |= pair.any(axis=1)
    return [(reps[i], components[i]) for i in np.flatnonzero(marked).tolist()]


def connecting_links(reps: tuple, components: tuple, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of different components, by their full sets; none between what earlier ones connect."""
    lengths = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(codes, kind="stable")
    members, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(codes))])
    ends, found = np.cumsum(lengths), []
    head = {c: c for c in components}

    def top(c: int) -> int:
        while head[c] != c:
            head[c] = head[head[c]]
            c = head[c]
        return c

    for i, own in enumerate(sets):
        mine = codes[ends[i] - len(own):ends[i]]
        sizes = starts[mine + 1] - starts[mine]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        both = np.bincount(members[np.repeat(starts[mine], sizes) + inner], minlength=len(sets))
        for j in np.flatnonzero(100 * both >= LINK * (lengths + len(own) - both)).tolist():
            if j > i and (a := top(components[i])) != (b := top(components[j])):
                head[b] = a
                found.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return found


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept, whether it is the component's smallest id.

    Sets are distinct shingles of SHINGLE words, A-Z lower-cased; sets are linked where 100 times their intersection is
    at least LINK times their union, confirmed on the full sets. Candidates are found by banding of MINIMA minima.

    Texts of equal words are one node, so a group of copies costs one row each. In a band's bucket all nodes are first
    compared with one of them, the next rounds with others, and the components of these links are formed. After
    LEADER_ROUNDS, the members of a bucket that are still in different components are all compared, in blocks of
    BLOCK_MEMBERS inside tasks: signatures first, full sets where they agree. A pair that shares a bucket is compared or
    connected already; its sets are compared if ALIKE minima agree, which 1 of 10^9 pairs at the limit fails. No step has a row per pair of a group; only links come out.

    Documents without words have no shingles and are their own component. Rows of one doc_id are one document and stay
    or go together. Rows with a null doc_id are linked with nothing: component_id null, kept. An empty table gives none.
    Other columns are not read.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = as_table(describe(source, "doc_id", "text"), "minhash-rows")
    nodes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = as_table(
        nodes.join(first.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
        .groupBy(F.col("doc_id").alias("rep"), "n_shingles").agg(F.min("signature").alias("signature")), "minhash-reps")

    banded = reps.select("rep", "n_shingles", F.posexplode(band_keys(F.col("signature"))).alias("place", "band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = as_table(banded.join(shared.select("band"), "band"), "minhash-members")
    links = members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    groups = None
    for turn in range(LEADER_ROUNDS + 1):
        placed = apart_members(members, groups)
        meet = (F.col("a") != F.col("b")) & (F.col("of_a") != F.col("of_b")) & (
            F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * LINK)
        left = placed.select("band", F.col("rep").alias("a"), F.col("component").alias("of_a"), F.col("n_shingles").alias("n_a"))
        right = placed.select("band", F.col("rep").alias("b"), F.col("component").alias("of_b"), F.col("n_shingles").alias("n_b"))
        if placed.isEmpty():
            break
        if turn == LEADER_ROUNDS:
            links = as_table(links.union(block_links(placed, reps, source)), "minhash-links")
            break
        # first the same one for all buckets that it is in, so that a great group of near copies has few pairs
        order = F.xxhash64(F.lit(turn), *(["band"] if turn else []), "a")
        left = left.groupBy("band").agg(F.min_by(F.struct("a", "of_a", "n_a"), order).alias("_l")).select("band", "_l.*")
        pairs = left.join(right, "band").where(meet).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = as_table(links.union(checked_links(pairs, reps, source)), "minhash-links")
        groups = components(links)
    # a copy of one doc_id with other words: its nodes are joined by the id
    same = nodes.join(first, "digest").where("rep < doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    mixed = nodes.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1")
    same = same.join(mixed.select(F.col("doc_id").alias("a")), "a", "left_semi").distinct()
    groups = components(links.union(same))

    placed = rows.select("doc_id", "digest", "n_shingles").join(first, "digest", "left")
    placed = placed.withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    placed = placed.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))
    labelled = placed.join(groups, "node", "left")
    component = F.coalesce("component", "node")
    return labelled.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, columns as they are."""
    gone = near_duplicates(docs, doc_id=doc_id, text=text).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = as_table(gone, "minhash-gone")
    return docs.join(broadcast_if_small(gone), F.col(f"`{doc_id}`") == F.col("_gone"), "left_anti")
