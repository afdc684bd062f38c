"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes by distance."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, LongType, StructField, StructType,
)

from .text import CACHE_WORDS, as_bytes, map_blocks

# Bounds of the sample of examples: of each label, and the length of each text.
EXAMPLES_EACH, EXAMPLE_BYTES = 2_500, 20_000
# Terms that tell the labels apart in the sample: so many at most, and by how many standard errors at least.
TERMS, SURE, LEAST_EXAMPLES = 4_000, 5.0, 4
FEW, UNSURE = 64, 3.0
# Neighbours that vote, and the distance at which a vote has half its weight.
NEIGHBOURS, HALF = 15, 0.1
BLOCK = 64
CACHE_ANSWERS = 4_000
DIGITS = 9
EVIDENCE = 3
REJECT = 0.3
PUNCTUATION = b".,;:!?\"'()[]{}<>*_-"
# A term is a word or one of its first letters of these lengths, so that inflected forms meet.
STEMS = (8, 7, 6, 5, 4)
HEAD = min(STEMS)


def terms_of(word: bytes) -> tuple[str, ...]:
    """Terms of a lower-cased word: itself without punctuation around it, and its stems."""
    plain = word.strip(PUNCTUATION).decode("utf-8", "replace")
    return (plain, *(f"{plain[:n]}-" for n in STEMS if len(plain) > n)) if plain else ()


class TermRows(dict):
    """Word to the row of its terms that are in the vocabulary; row 0 has none. A bounded cache."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary, self.rows, self.known = vocabulary, [()], {(): 0}
        # each term of a word begins as the word does, so most words are known to have none by their first bytes
        self.heads = {term.encode()[:HEAD] for term in vocabulary}
        self.answers: dict[tuple, tuple] = {}  # by term counts, since many texts have the same few

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if word.isascii() and word.strip(PUNCTUATION)[:HEAD] not in self.heads:
            self[word] = 0
            return 0
        terms = tuple(i for t in terms_of(word) if (i := self.vocabulary.get(t)) is not None)
        row = self.known.get(terms)
        if row is None:
            row = self.known[terms] = len(self.rows)
            self.rows.append(terms)
        self[word] = row
        return row

    def counts(self, text: bytes) -> dict[int, int]:
        """How often each term of the vocabulary is in the text."""
        words = text.lower().split()
        rows = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        rows = rows[rows > 0]
        out: dict[int, int] = {}
        if len(rows):
            for row, times in Counter(rows.tolist()).items():
                for term in self.rows[row]:
                    out[term] = out.get(term, 0) + times
        return out

    def present(self, text: bytes) -> list[int]:
        """The terms of the vocabulary that are in the text."""
        held = set(map(self.__getitem__, set(text.lower().split())))
        return list({term for row in held for term in self.rows[row]})


@dataclass
class Index:
    """Examples by term: ``where[starts[t, b]:starts[t, b + 1]]`` are term t's examples in block b, by their number."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    where: np.ndarray
    weights: np.ndarray
    largest: np.ndarray
    knots: list[tuple[float, float]] = field(default_factory=list)
    alone: float = 0.0

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their TF-IDF weights, of length 1."""
        terms = np.fromiter(sorted(counts), np.int64, len(counts))
        weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms]
        return terms, weights / math.sqrt(float((weights**2).sum()))

    def nearest(self, counts: dict[int, int], k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the ``k`` nearest, exactly; ties to the smaller number. Cosines of 0 don't count.

        A block's bound is the sum of its terms' largest weights. Blocks are read from the highest bound on, equal ones
        in order, until no later block can hold a better one than the k-th. Cosines count to DIGITS places.
        """
        if not counts:
            return []
        terms, weights = self.weigh(counts)
        bounds = np.round(weights @ self.largest[terms], DIGITS)
        order = np.argsort(-bounds, kind="stable")
        order = order[:int((bounds > 0).sum())]
        cosines, numbers, start, take = np.empty(0), np.empty(0, np.int64), 0, 2
        while start < len(order):
            blocks = order[start:start + take]
            if len(cosines) >= k:
                floor = cosines[-1]
                # an equal cosine of a larger number is no better
                worth = (bounds[blocks] > floor) | (bounds[blocks] == floor) & (blocks * BLOCK <= numbers[-1])
                if not worth[0]:
                    break
                blocks = blocks[worth]
            # the postings of all terms in these blocks, one after another
            first, last = self.starts[terms[:, None], blocks].ravel(), self.starts[terms[:, None], blocks + 1].ravel()
            sizes = last - first
            at = np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            parts = self.weights[at] * np.repeat(np.repeat(weights, len(blocks)), sizes)
            scores = np.round(np.bincount(self.where[at], parts, len(self.labels)), DIGITS)
            hits = np.flatnonzero(scores)
            hits = hits[hits != without]
            cosines, numbers = np.concatenate([cosines, scores[hits]]), np.concatenate([numbers, hits])
            best = np.lexsort((numbers, -cosines))[:k]
            cosines, numbers, start, take = cosines[best], numbers[best], start + take, 2 * take
        return list(zip(cosines.tolist(), numbers.tolist()))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, each by 1 / (distance + HALF)."""
        votes = np.array([1 / (max(0.0, 1 - c) + HALF) for c, _ in near])
        return float((votes * self.labels[[i for _, i in near]]).sum() / votes.sum())

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.alone
        x, y = zip(*self.knots)
        raw = self.vote(near)
        # the rest of the vote keeps apart what the steps of the calibration bring together
        return float(np.clip(0.99 * np.interp(raw, x, y) + 0.01 * raw, 0, 1))


def choose_terms(texts: list[bytes], labels: np.ndarray) -> list[str]:
    """Terms whose shares of examples differ between the labels by SURE standard errors or more; at most TERMS.

    For the FEW that differ most, UNSURE standard errors do, so that a handful of examples is enough to learn from.
    """
    seen: dict[str, list[int]] = {}
    for text, label in zip(texts, labels.tolist()):
        for term in {t for w in set(text.lower().split()) for t in terms_of(w)}:
            seen.setdefault(term, [0, 0])[label] += 1
    ones, zeros = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    found = []
    for term, (n0, n1) in seen.items():
        if n0 + n1 >= LEAST_EXAMPLES:
            share = (n0 + n1) / (ones + zeros)
            error = math.sqrt(max(share * (1 - share), 1e-9) * (1 / ones + 1 / zeros))
            found.append((-abs(n1 / ones - n0 / zeros) / error, term))
    return [term for i, (z, term) in enumerate(sorted(found)[:TERMS]) if -z >= (SURE if i >= FEW else UNSURE)]


def build_index(ids: list, texts: list[bytes], labels: np.ndarray, vocabulary: dict[str, int], idf: np.ndarray,
                base_rate: float) -> Index:
    """Examples in the order of their heaviest term, so that few blocks hold a term and bounds are tight."""
    rows = TermRows(vocabulary)
    counts = [rows.counts(t) for t in texts]
    heaviest = [max(((1 + math.log(n)) * idf[t], -t) for t, n in c.items()) if c else (0.0, 0) for c in counts]
    order = sorted(range(len(texts)), key=lambda i: (-heaviest[i][1], heaviest[i][0], i))
    ids, labels, counts = [ids[i] for i in order], labels[order], [counts[i] for i in order]
    blocks = max(1, math.ceil(len(ids) / BLOCK))
    index = Index(vocabulary, idf, labels, np.array(ids), np.zeros((len(idf), blocks + 1), np.int64), np.empty(0, np.int64),
                  np.empty(0), np.zeros((len(idf), blocks)))
    postings = [(int(t), i, float(w)) for i, c in enumerate(counts) if c for t, w in zip(*index.weigh(c))]
    postings.sort()
    if postings:
        term, where, weight = (np.array(x) for x in zip(*postings))
        key = term * blocks + where // BLOCK
        edges = np.arange(len(idf))[:, None] * blocks + np.arange(blocks + 1)[None]
        index.starts, index.where, index.weights = np.searchsorted(key, edges), where, weight
        np.maximum.at(index.largest, (term, where // BLOCK), weight)
    calibrate(index, counts, base_rate)
    return index


def calibrate(index: Index, counts: list[dict[int, int]], base_rate: float) -> None:
    """From votes to rates of label 1: a rising step function over the examples, each judged without itself.

    The sample has as many of each label as it can get, so examples count by the label's share among all labelled rows.
    """
    ones = max(1, int(index.labels.sum()))
    share = np.where(index.labels == 1, base_rate / ones, (1 - base_rate) / max(1, len(index.labels) - ones))
    share = share * len(index.labels)
    raw = np.array([index.vote(near) if (near := index.nearest(c, NEIGHBOURS, i)) else -1.0 for i, c in enumerate(counts)])
    lone = raw < 0
    index.alone = float(((share * index.labels)[lone].sum() + base_rate) / (share[lone].sum() + 1))
    pools: list[list[float]] = []  # mean vote, rate, weight: neighbouring pools that fall are made one
    for i in np.argsort(raw, kind="stable")[int(lone.sum()):].tolist():
        pools.append([raw[i], float(index.labels[i]), share[i]])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1]):
            x, y, w = pools.pop()
            last = pools[-1]
            total = last[2] + w
            pools[-1] = [(last[0] * last[2] + x * w) / total, (last[1] * last[2] + y * w) / total, total]
    index.knots = [(x, (y * w + base_rate) / (w + 1)) for x, y, w in pools] or [(0.0, base_rate)]
    index.knots = [(x, max(v for _, v in index.knots[:i + 1])) for i, (x, _) in enumerate(index.knots)]


def train_index(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str) -> Index | None:
    """The index over a bounded sample of examples; None without examples of both labels.

    At most EXAMPLES_EACH labelled rows of each label, by the order of a hash of the id, of at most EXAMPLE_BYTES bytes;
    equal texts count once. The base rate of the labels and the terms' document frequencies are over all rows.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(f"`{label}`").cast("int").alias("y")).where(
        "y IN (0, 1) AND _id IS NOT NULL").groupBy("_id").agg(F.max("y").alias("y"))
    totals = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    hashed = marked.withColumn("h", F.xxhash64("_id"))
    chosen = None
    for y in (0, 1):
        some = hashed.where(F.col("y") == y).orderBy("h", "_id").limit(EXAMPLES_EACH)
        chosen = some if chosen is None else chosen.union(some)
    source = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    sample = source.where(F.octet_length("t") <= EXAMPLE_BYTES).join(F.broadcast(chosen), "_id").collect()
    by_text: dict[bytes, tuple] = {}
    for r in sorted(sample, key=lambda r: (r.h, r._id)):
        by_text.setdefault(bytes(r.t), (r._id, r.y))
    texts, ids, y = [*by_text], [i for i, _ in by_text.values()], np.array([v for _, v in by_text.values()], np.int64)
    terms = choose_terms(texts, y)
    if not terms:
        return None
    vocabulary = {t: i for i, t in enumerate(terms)}
    n, df = document_frequencies(source, vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 1
    return build_index(ids, texts, y, vocabulary, idf, totals[1] / (totals[0] + totals[1])) if n else None


def document_frequencies(source: DataFrame, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """Rows, and rows with each term, over all of ``source``: one row per term from each task, then sums."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = TermRows(vocabulary), np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                seen[rows.present(text)] += 1
                seen[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["term", "n"])

    counts = source.select("t").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in counts:
        out[r.term] = r.n
    return int(out[-1]), out[:-1]


def _scored(index: Index | None, texts: list[bytes], rows: TermRows | None) -> list[tuple[float, list]]:
    if index is None:
        return [(0.0, []) for _ in texts]
    out = []
    for text in texts:
        counts = rows.counts(text)
        key = tuple(sorted(counts.items()))
        if key not in rows.answers:
            if len(rows.answers) >= CACHE_ANSWERS:
                rows.answers.clear()
            near = index.nearest(counts, NEIGHBOURS)
            rows.answers[key] = index.score(near), near
        out.append(rows.answers[key])
    return out


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> DataFrame:
    """Per row of ``docs``: doc_id, ``score`` (0 to 1) and ``evidence``, its nearest examples' (doc_id, label, cosine).

    ``labels`` (doc_id, ``label`` 0 or 1) are the rows that may be learnt from. Terms are words and their beginnings;
    those that tell the sample's labels apart are the vocabulary. A text's nearest examples by TF-IDF cosine, found
    exactly, vote by distance, and the vote is calibrated to a rate. Nothing but the text enters a score.

    The index is of bounded size (EXAMPLES_EACH of each label, TERMS) and is broadcast; frequencies, scores and the
    search cover all rows and whole texts. Three passes over the texts, no shuffle of any text.

    Null and empty texts, and texts without a term of the vocabulary, get the rate of examples without neighbours.
    Repeated rows score alike. Without usable labels every score is 0. Other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(
        train_index(docs, labels, doc_id=doc_id, text=text, label=label))
    seen = StructType([StructField("doc_id", LongType()), StructField("label", LongType()),
                       StructField("cosine", DoubleType())])
    schema = StructType([docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema["doc_id"],
                         StructField("score", DoubleType()), StructField("evidence", ArrayType(seen))])
    seen_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int64()), ("cosine", pa.float64())]))
    columns = {"doc_id": F.col(f"`{doc_id}`"), "text": F.col(f"`{text}`").cast("binary")}
    rows: list[TermRows] = []

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = index.value
        if known is not None and not rows:
            rows.append(TermRows(known.vocabulary))
        made = _scored(known, as_bytes(batch.column("text")), rows[0] if rows else None)
        evidence = [[{"doc_id": int(known.ids[i]), "label": int(known.labels[i]), "cosine": c}
                     for c, i in near[:EVIDENCE]] for _, near in made]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([s for s, _ in made], pa.float64()), pa.array(evidence, seen_type)],
            ["doc_id", "score", "evidence"])

    return map_blocks(docs, columns, block, schema, "text")


def reject_toxic(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    reject: float = REJECT,
) -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, columns as they are. Cases as in :func:`score_toxicity`."""
    index = docs.sparkSession.sparkContext.broadcast(
        train_index(docs, labels, doc_id=doc_id, text=text, label=label))
    place = docs.columns.index(text)
    rows: list[TermRows] = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        if known is not None and not rows:
            rows.append(TermRows(known.vocabulary))
        for batch in batches:
            made = _scored(known, as_bytes(batch.column(place)), rows[0] if rows else None)
            yield batch.filter(pa.array([s < reject for s, _ in made], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
