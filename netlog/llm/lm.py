"""Language-model scores by masked pseudo-likelihood: a window network predicts every word from both of its sides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..session import as_table
from .text import as_bytes, hash_words, in_blocks, map_blocks

# Words hash into this many buckets; the most frequent have a class each, the others share the rest.
BUCKET_BITS, GROUPS, MEMBERS, OWN = 16, 16, 16, 224
BUCKETS, CLASSES = 1 << BUCKET_BITS, GROUPS * MEMBERS
# Words to each side, and the width of the hidden layer.
SIDE, WIDTH = 2, 16
OFFSETS = (-2, -1, 1, 2)
# Training: passes over the whole corpus, words in a step, step size.
ROUNDS, STEP_WORDS, RATE = 2, 8_192, 0.2
SEED = 11


@dataclass(frozen=True)
class Vocabulary:
    """Class of each bucket, and the log-probability of a bucket within its class, from counts over the whole corpus."""

    classes: np.ndarray
    within: np.ndarray


def make_vocabulary(counts: np.ndarray) -> Vocabulary:
    """The OWN most frequent buckets have a class each; the others, by frequency, take turns in the remaining classes."""
    order = np.lexsort((np.arange(BUCKETS), -counts))
    classes = np.empty(BUCKETS, np.int16)
    classes[order[:OWN]] = np.arange(OWN)
    classes[order[OWN:]] = OWN + np.arange(BUCKETS - OWN) % (CLASSES - OWN)
    smooth = counts + 1.0
    return Vocabulary(classes, np.log(smooth / np.bincount(classes, smooth, CLASSES)[classes]))


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of the texts one after another, A-Z lower-cased, and each text's number of words."""
    words: list[bytes] = []
    counts = []
    for text in texts:
        own = text.lower().split()
        words += own
        counts.append(len(own))
    return (hash_words(words) >> np.uint64(64 - BUCKET_BITS)).astype("<u2"), np.array(counts, np.int64)


def bucket_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, buckets): each text as packed 16-bit buckets, a few bytes a word, read again by every later pass."""
    schema = StructType([docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema["doc_id"],
                         StructField("buckets", BinaryType())])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, counts = buckets_of(as_bytes(batch.column("text")))
        ends = np.concatenate([[0], np.cumsum(2 * counts)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(buckets)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), packed], ["doc_id", "buckets"])

    columns = {"doc_id": F.col(f"`{doc_id}`"), "text": F.col(f"`{text}`").cast("binary")}
    return map_blocks(docs, columns, block, schema, "text")


def unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts one after another, and each text's number of words."""
    values = as_bytes(packed)
    return np.frombuffer(b"".join(values), "<u2"), np.array([len(v) // 2 for v in values], np.int64)


def windows(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes [place, word] around each word; beyond the text's ends the class CLASSES."""
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.full((len(OFFSETS), len(classes)), CLASSES, np.int16)
    for row, offset in zip(out, OFFSETS):
        to, by = (slice(-offset, None), slice(None, offset)) if offset < 0 else (slice(None, -offset), slice(offset, None))
        same = owner[to] == owner[by]
        row[to][same] = classes[by][same]
    return out


class Network:
    """Embeddings by place, summed into a hidden layer; from it the word's group of classes, and the class in the group.

    Arrays are [unit, word], so that sums over units run along whole rows.
    """

    shapes = ((len(OFFSETS), WIDTH, CLASSES + 1), (WIDTH, 1), (GROUPS, WIDTH), (GROUPS, 1), (GROUPS, MEMBERS, WIDTH),
              (GROUPS, MEMBERS, 1))

    def __init__(self, flat: np.ndarray | None = None) -> None:
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            flat = np.random.default_rng(SEED).normal(0, 0.1, sum(sizes))
        self.flat = flat.astype(np.float32)
        self.slices = np.cumsum([0, *sizes])
        self.parts = self.split(self.flat)

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[a:b].reshape(s) for a, b, s in zip(self.slices, self.slices[1:], self.shapes)]

    def forward(self, around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """For words in the order of their groups: hidden layer, both log-softmaxes, and the groups' ends."""
        place, bias, outer, outer_bias, inner, inner_bias = self.parts
        h = bias + place[0].take(around[0], axis=1)
        for i in range(1, len(OFFSETS)):
            h += place[i].take(around[i], axis=1)
        np.tanh(h, out=h)
        ends = np.cumsum(np.bincount(target // MEMBERS, minlength=GROUPS)).tolist()
        members = np.empty((MEMBERS, len(target)), np.float32)
        for g, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                np.matmul(inner[g], h[:, a:b], out=members[:, a:b])
                members[:, a:b] += inner_bias[g]
        return h, log_softmax(outer @ h + outer_bias), log_softmax(members), ends

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = by_group(target)
        sorted_target = target[order]
        _, groups, members, _ = self.forward(around[:, order], sorted_target)
        each = np.arange(len(target))
        out = np.empty(len(target))
        out[order] = groups[sorted_target // MEMBERS, each] + members[sorted_target % MEMBERS, each]
        return out

    def gradient(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean log-probability, by parameter."""
        order = by_group(target)
        around, target = around[:, order], target[order]
        h, groups, members, ends = self.forward(around, target)
        _, _, outer, _, inner, _ = self.parts
        each = np.arange(len(target))
        flat = np.zeros_like(self.flat)
        d_place, d_bias, d_outer, d_outer_bias, d_inner, d_inner_bias = self.split(flat)
        for gap, hit in ((groups, target // MEMBERS), (members, target % MEMBERS)):
            np.exp(gap, out=gap)
            np.negative(gap, out=gap)
            gap[hit, each] += 1
        d_outer[:], d_outer_bias[:] = groups @ h.T, groups.sum(axis=1, keepdims=True)
        back = outer.T @ groups
        for g, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                gap = members[:, a:b]
                d_inner[g], d_inner_bias[g] = gap @ h[:, a:b].T, gap.sum(axis=1, keepdims=True)
                back[:, a:b] += inner[g].T @ gap
        back *= 1 - h * h
        d_bias[:] = back.sum(axis=1, keepdims=True)
        for i in range(len(OFFSETS)):
            order = np.argsort(around[i], kind="stable")
            at = around[i][order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            d_place[i][:, at[first]] = np.add.reduceat(back.take(order, axis=1), first, axis=1)
        return flat / len(target)


def by_group(target: np.ndarray) -> np.ndarray:
    return np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")


def log_softmax(logits: np.ndarray) -> np.ndarray:
    """Along the first axis, in place."""
    logits -= logits.max(axis=0)
    logits -= np.log(np.exp(logits).sum(axis=0))
    return logits


def train_pass(
    network: Network, vocabulary: Vocabulary, blocks: Iterable[tuple[np.ndarray, np.ndarray]]
) -> tuple[Network, int]:
    """The network after one pass over the blocks, with steps by the size of past gradients; and the words seen."""
    network, past, seen = Network(network.flat), np.full(len(network.flat), 1e-6, np.float32), 0
    rng = np.random.default_rng(SEED)
    for buckets, counts in blocks:
        target = vocabulary.classes[buckets]
        around = windows(target, counts)
        seen += len(target)
        # neighbours in a step would be of the same texts
        order = rng.permutation(len(target))
        for s in range(0, len(order), STEP_WORDS):
            rows = order[s:s + STEP_WORDS]
            grad = network.gradient(around[:, rows], target[rows])
            past += grad * grad
            network.flat += RATE * min(1.0, len(rows) / STEP_WORDS) * grad / np.sqrt(past)
    return network, seen


def packed_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
        yield from (unpacked(part.column(0)) for part in in_blocks(batch, sizes))


def corpus_counts(packed: DataFrame) -> np.ndarray:
    """Words of each bucket over the whole corpus: a task adds up its own first."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for buckets, _ in packed_blocks(batches):
            counts += np.bincount(buckets, minlength=BUCKETS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in packed.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def train(packed: DataFrame, vocabulary: Vocabulary) -> Network:
    """ROUNDS passes over the whole corpus: each task trains on all of its texts, then parameters are averaged by words.

    The average is formed per parameter in Spark; the driver holds one network.
    """
    network = Network()
    for _ in range(ROUNDS):
        start = packed.sparkSession.sparkContext.broadcast((network.flat, vocabulary))

        def run(batches: Iterable[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            flat, known = start.value
            made, seen = train_pass(Network(flat), known, packed_blocks(batches))
            if seen:
                values = made.flat.astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values))), pa.array(values * seen), pa.array(np.full(len(values), seen))],
                    ["place", "total", "words"])

        mean = (F.sum("total") / F.sum("words")).alias("value")
        rows = packed.mapInArrow(run, "place long, total double, words long").groupBy("place").agg(mean).collect()
        if not rows:
            return network
        flat = np.zeros(len(network.flat))
        for r in rows:
            flat[r.place] = r.value
        network = Network(flat)
    return network


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, ``log_prob``, the sum of its words' conditional log-probabilities, and
    ``mean_log_prob`` per word.

    A word's probability given SIDE words on both sides is that of its class, by a network trained on all of ``docs``,
    times that of its bucket within the class, by counts over all of ``docs``. Counts and training grow with the corpus;
    the model's size is fixed. Texts are read once and kept as packed buckets in the session's checkpoint folder; no text
    is shuffled.

    Null and empty texts have no words: log_prob 0, mean_log_prob null. Repeated rows score alike, but for rounding.
    Other columns are not read. An empty table gives none.
    """
    tokens = as_table(bucket_table(docs, doc_id, text), "lm-tokens")
    packed = tokens.select("buckets")
    vocabulary = make_vocabulary(corpus_counts(packed))
    model = docs.sparkSession.sparkContext.broadcast((train(packed, vocabulary).flat, vocabulary))
    schema = StructType([tokens.schema["doc_id"], StructField("n_words", LongType()),
                         StructField("log_prob", DoubleType()), StructField("mean_log_prob", DoubleType())])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, known = model.value
        network = Network(flat)
        buckets, counts = unpacked(batch.column("buckets"))
        target = known.classes[buckets]
        around = windows(target, counts)
        logs = known.within[buckets]
        for s in range(0, len(target), STEP_WORDS):
            logs[s:s + STEP_WORDS] += network.log_probabilities(around[:, s:s + STEP_WORDS], target[s:s + STEP_WORDS])
        ends = np.concatenate([[0.0], np.cumsum(logs)])[np.cumsum(np.concatenate([[0], counts]))]
        sums = np.diff(ends)
        means = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts), pa.array(sums), means],
            ["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return map_blocks(tokens, {"doc_id": F.col("doc_id"), "buckets": F.col("buckets")}, block, schema, "buckets")
