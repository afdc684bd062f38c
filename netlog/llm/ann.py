"""Nearest neighbours by inner product: inverted lists of rotated vectors, scanned in blocks of columns.

After each block a hypothesis test on the partial distance drops candidates that are very unlikely to get among the
nearest, so that most are never read to the last column.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import as_table
from .text import hash_below

# Bound of the sample that the lists, the number of probes and the first thresholds come from.
SAMPLE = 20_000
# Sample queries against the whole sample that set the number of probes, and the share of neighbours they must find.
TRIAL_QUERIES, TRIAL_RECALL = 300, 0.97
# Columns read between two tests, and how sure a test is: a candidate goes if its scaled partial distance exceeds the
# radius by SURE / sqrt(columns read).
COLUMNS, SURE = 16, 2.1
# Vectors and queries of a list that meet in one task; larger lists are cut up.
CELL_VECTORS, CELL_QUERIES, QUERY_BLOCK = 8_192, 4_096, 256


@dataclass(frozen=True)
class Index:
    """What the sample gives: list centres, a random rotation, the sample itself and how many lists to probe."""

    centres: np.ndarray
    rotation: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    own: np.ndarray
    probes: int


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, every component finite, the id not null."""
    v = F.col("v")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                          F.col(f"`{embedding}`").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & good & F.exists(v, lambda x: x != 0))


def top(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def train_index(rows: list, count: int, k: int, seed: int = 0) -> Index:
    """Lists by k-means over the sample, half the root of ``count`` of them; probes by trial on the sample.

    Each trial query is compared with the whole sample; as many lists are probed as it takes to hold TRIAL_RECALL of
    the true ``k`` nearest. In the whole table neighbours are nearer than in the sample, so it takes no more there.
    Equal vectors are tried once and start one list, and no list is empty in the sample.
    """
    rng = np.random.default_rng(seed)
    ids = np.array([r.vec_id for r in rows], np.int64)
    x = np.array([r.v for r in rows], np.float64)
    distinct = np.sort(np.unique(x, axis=0, return_index=True)[1])
    lists = max(1, min(len(distinct), math.ceil(math.sqrt(count) / 2)))
    centres = x[rng.permutation(distinct)[:lists]].copy()
    for _ in range(10):
        own = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=lists)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    own = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    used, own = np.unique(own, return_inverse=True)
    centres, lists = centres[used], len(used)
    probes = lists
    if len(x) > k + 1:
        trial = rng.permutation(distinct)[:TRIAL_QUERIES]
        scores = x[trial] @ x.T
        scores[np.arange(len(trial)), trial] = -np.inf
        order = np.argsort(-(x[trial] @ centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(lists)[None], axis=1)
        needed = np.take_along_axis(place, own[top(scores, k)], axis=1).ravel()
        probes = int(np.sort(needed)[math.ceil(TRIAL_RECALL * len(needed)) - 1]) + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    return Index(centres, rotation, ids, x, own, probes)


def scan(x: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that may have an inner product of ``least`` or more, of rotated vectors.

    |x - q|^2 = |x|^2 + |q|^2 - 2 xq, so the threshold on xq is a radius for the distance. The distance over the first
    d of D columns, times D / d, estimates the whole; past (1 + SURE / sqrt(d)) times the radius, the candidate goes.
    While many are left, a block is one matrix product; when few are, only their columns are read.
    """
    width = x.shape[1]
    radius = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * least[:, None]
    radius = np.maximum(radius + 1e-6 * np.abs(radius) + 1e-9, 0)
    part, pairs = np.zeros((len(q), len(x))), None
    for start in range(0, width, COLUMNS):
        a, b = x[:, start:start + COLUMNS], q[:, start:start + COLUMNS]
        seen = min(start + COLUMNS, width)
        # the whole distance is known after the last block: no allowance but for rounding
        room = seen / width * (1 + SURE / math.sqrt(seen))**2 if seen < width else 1.0
        if pairs is None:
            part += (b**2).sum(axis=1)[:, None] + (a**2).sum(axis=1)[None] - 2 * (b @ a.T)
            alive = part <= radius * room
            if alive.mean() < 0.1 or seen == width:
                pairs = np.nonzero(alive)
                part, radius = part[pairs], radius[pairs]
        else:
            part += ((a[pairs[1]] - b[pairs[0]])**2).sum(axis=1)
            keep = part <= radius * room
            pairs, part, radius = (pairs[0][keep], pairs[1][keep]), part[keep], radius[keep]
    return pairs


def search_cell(index: Index, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, least: np.ndarray,
                k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) of up to ``k`` nearest of a cell, by exact products of the original vectors."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    turned = x @ index.rotation
    for s in range(0, len(q), QUERY_BLOCK):
        qq = q[s:s + QUERY_BLOCK]
        who, what = scan(turned, qq @ index.rotation, least[s:s + QUERY_BLOCK])
        own = qids[s:s + QUERY_BLOCK][who]
        who, what, own = (v[own != ids[what]] for v in (who, what, own))
        scores = np.empty(len(who))
        for c in range(0, len(who), 100_000):
            scores[c:c + 100_000] = (x[what[c:c + 100_000]] * qq[who[c:c + 100_000]]).sum(axis=1)
        rank = np.lexsort((ids[what], -scores, who))
        who, what, own, scores = who[rank], what[rank], own[rank], scores[rank]
        if len(set(ids.tolist())) < len(ids):  # of rows with one id, the best counts
            best = np.sort(np.unique(np.stack([who, ids[what]]), axis=1, return_index=True)[1])
            who, what, own, scores = who[best], what[best], own[best], scores[best]
        first = np.searchsorted(who, who, side="left")
        best = np.arange(len(who)) - first < k
        yield own[best], ids[what[best]], scores[best]


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score: the product in double precision on the original vectors, ties to
    the smaller id. A query's own id is no candidate. Approximate: the lists that a query does not probe, and with
    little probability a candidate that a test drops, can miss neighbours; recall is set by trial on a sample, whatever
    the table's size. A query whose lists hold fewer than ``k`` candidates goes on to the next ones.

    About SAMPLE vectors (never twice as many), by a hash of the id, go to the driver and come back as the index; every row is
    indexed. A query also probes the lists of its ``k`` nearest in the sample. The k-th best product among
    these is its threshold, which none of its neighbours is below, so lists return few rows; they are candidates
    whatever a test says of them. Vectors and probing queries meet by list, in cells of bounded size: a list with many rows
    or many queries is cut up, every part of one against every part of the other.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those whose length is not
    the sample's most frequent one. Rows that repeat an id count once, at their best score. With fewer than ``k``
    candidates all are returned; an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    result = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()),
                         StructField("score", DoubleType())])
    rows, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    total = rows.count()
    sample = rows.where(hash_below(F.xxhash64("vec_id"), SAMPLE, total)).limit(2 * SAMPLE).collect()
    sample.sort(key=lambda r: (r.vec_id, r.v))
    sample = [r for i, r in enumerate(sample) if not i or sample[i - 1].vec_id != r.vec_id]
    widths = [len(r.v) for r in sample]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if len(set(widths)) > 1 else (widths or [0])[0]
    rows, asked = rows.where(F.size("v") == width), asked.where(F.size("v") == width)
    sample = [r for r in sample if len(r.v) == width]
    count = rows.count()
    empty = spark.createDataFrame([], StructType([StructField("query_id", LongType()), StructField("rank", IntegerType()),
                                                  StructField("vec_id", LongType()), StructField("score", DoubleType())]))
    if not sample:
        return empty
    index = train_index(sample, count, k)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = matrix(batch.column(1), width)
            own = (x @ index.centres.T - (index.centres**2).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["vec_id", "v", "list"])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(s, QUERY_BLOCK)
                x, ids = matrix(part.column(1), width), part.column(0).to_numpy()
                known = x @ index.vectors.T
                order = np.argsort(-(x @ index.centres.T), axis=1)
                # one of the ids may be the query's own
                short = (np.cumsum(held[order], axis=1) < k + 1).sum(axis=1)
                reach = np.arange(order.shape[1])[None] < np.maximum(index.probes, short + 1)[:, None]
                probed = np.zeros(order.shape, bool)
                np.put_along_axis(probed, order, reach, axis=1)
                known[ids[:, None] == index.ids[None]] = -np.inf
                near = top(known, min(k, known.shape[1]))
                there = np.isfinite(np.take_along_axis(known, near, axis=1))
                # where the sample's nearest are, others may be; a query far from all centres needs more lists than most
                np.logical_or.at(probed, (np.nonzero(there)[0], index.own[near[there]]), True)
                lists = [np.flatnonzero(row).astype(np.int32) for row in probed]
                scores = (index.vectors[near] * x[:, None]).sum(axis=2)
                full = there.sum(axis=1) == k
                least = np.where(full, np.where(there, scores, np.inf).min(axis=1), -1e300)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(least), pa.array(lists, pa.list_(pa.int32())),
                     pa.array([index.ids[n[t]] for n, t in zip(near, there)], pa.list_(pa.int64())),
                     pa.array([s[t] for s, t in zip(scores, there)], pa.list_(pa.float64()))],
                    ["query_id", "q", "least", "lists", "ids", "scores"])

    vector = ArrayType(DoubleType())
    placed = rows.mapInArrow(assign, StructType([
        StructField("vec_id", LongType()), StructField("v", vector), StructField("list", IntegerType())]))
    # ids of each list, as many rows as there are lists; an id in several counts in one, so that no sum is too high
    held = np.zeros(len(index.centres), np.int64)
    for r in placed.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    started = as_table(asked.mapInArrow(probe, StructType([
        StructField("query_id", LongType()), StructField("q", vector), StructField("least", DoubleType()),
        StructField("lists", ArrayType(IntegerType())), StructField("ids", ArrayType(LongType())),
        StructField("scores", ArrayType(DoubleType()))])), "probing")
    probing = started.select("query_id", "q", "least", F.explode("lists").alias("list"))
    known = started.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("s")).select(
        "query_id", F.col("s.ids").alias("vec_id"), F.col("s.scores").alias("score"))
    # parts of each list: at most as many rows as there are lists
    parts = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_VECTORS).cast("int").alias("parts")).join(
        probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("qparts")), "list")
    each = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("qparts") - 1)
    left = placed.join(F.broadcast(parts), "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(each[1]).alias("qpart"),
        "vec_id", "v")
    right = probing.join(F.broadcast(parts), "list").select(
        "list", F.explode(each[0]).alias("part"), F.pmod(F.xxhash64("query_id"), "qparts").cast("int").alias("qpart"),
        "query_id", "q", "least")

    def cell(vs: pa.Table, qs: pa.Table) -> pa.Table:
        if not vs.num_rows or not qs.num_rows:
            return pa.table([[], [], []], pa.schema(
                [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))
        found = list(search_cell(
            shared.value, vs["vec_id"].to_numpy(), matrix(vs["v"], width), qs["query_id"].to_numpy(),
            matrix(qs["q"], width), qs["least"].to_numpy(), k))
        return pa.table({name: np.concatenate([f[i] for f in found])
                         for i, name in enumerate(("query_id", "vec_id", "score"))})

    keys = ["list", "part", "qpart"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, result)
    best = found.union(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
