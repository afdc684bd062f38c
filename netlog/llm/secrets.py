"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to what they find."""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .text import CACHE_WORDS, as_bytes, hash_below, map_blocks

# The three patterns, the order of their kinds, and the least length of what each takes.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 8, "access": 16}

# The field's states. Every token of a text has one.
BEGIN, INSIDE, OUTSIDE = range(3)
# A line feed is no token, it parts lines. Characters beyond ASCII are in no pattern; a run of them is one token.
TOKEN = re.compile(r"\n|[A-Za-z0-9+/_.-]+=*|[^\s\x00-\x7f]+|[^\s]")
LINE_END = "\n"
# Features hash into this many weights per state.
WEIGHTS = 1 << 14
# Classes of tokens: long ones with a digit, other long ones, the rest. All weights are a class's own, so that the many
# plain words do not speak for the few codes.
LONG, CLASSES = 8, 3
# A token has SHAPE features of its own, and gives one of each class to the neighbours that it is SIDES of.
SHAPE, SIDES = 11, (2, 1, -1, -2)
SIDE_SUMS = [zlib.crc32(f"{side:+} {kind} ".encode()) for side in SIDES for kind in range(CLASSES)]
KINDS_OF_CHARS = [(name, frozenset(chars)) for name, chars in (
    ("x", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("L", "GHIJKLMNOPQRSTUVWXYZ"), ("s", "+/=_"), ("d", ".-"))]
# Words whose weights a process keeps, about 0.4 KB each; beyond it the cache starts anew.
KNOWN_WORDS = 300_000

# Bounds of the training sample: texts with a pattern in them, texts with any digit, and the length of each.
TRAIN_WITH, TRAIN_ANY, TRAIN_CHARS = 1_000, 1_000, 20_000
# Tokens of a stretch that is learnt from, and how many stretches without a secret or a long token with a digit.
STRETCH, PLAIN_STRETCHES = 16, 1_000
# Sums of gains over many tokens are compared with so much room.
ROUNDING = 1e-3


@dataclass(frozen=True)
class Field:
    """Weights of features by state, and of a state by the one before it."""

    emit: np.ndarray
    move: np.ndarray


def pattern_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, first and last character of the secret itself) of the fixed patterns, in order."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST["access"]:
            found.append((m.start(), 1, m.end(), m.start(), m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m.start(), m.end()))
    return sorted(found)


class Words(dict):
    """Word to its row in a table. Row 0 is the end of a line. ``rows``, the words' features, and ``classes`` are in that order.

    ``rows`` are those of the words that came since it was last cleared.
    """

    def __init__(self) -> None:
        self.rows, self.classes = [word_features("")], [word_class("")]
        self[LINE_END] = 0

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.rows.append(word_features(word))
        self.classes.append(word_class(word))
        return row


class Emissions:
    """Words with the field's weights of their features: a bounded cache, by row [row, own sum or side and class, state]."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.words, self.table = Words(), np.empty((0, 1 + len(SIDE_SUMS), 3), np.float32)

    def of(self, tokens: Tokens, texts: list[str]) -> np.ndarray:
        """Emission [place, state] of all tokens of ``texts``."""
        new = np.array(self.words.rows, np.int64).reshape(-1, SHAPE + len(SIDE_SUMS))
        self.words.rows.clear()
        own, sides = self.field.emit[new[:, :SHAPE]].sum(axis=1), self.field.emit[new[:, SHAPE:]]
        self.table = np.concatenate([self.table, np.concatenate([own[:, None], sides], axis=1, dtype=np.float32)])
        kinds = np.array(self.words.classes)[tokens.rows]
        out = self.field.emit[files(texts)].sum(axis=2)[tokens.owner, kinds] + self.table[:, 0][tokens.rows]
        flat, width = self.table.reshape(-1, 3), self.table.shape[1]
        for side, (here, there) in enumerate(NEIGHBOURS):
            out[here] += flat[tokens.rows[there] * width + (1 + CLASSES * side) + kinds[here]]
        return out


KNOWN: dict[str, Emissions] = {}


def known_words(field: Field, name: str) -> Emissions:
    """The words that this process has met under the field called ``name``; those of any other are given up."""
    if name not in KNOWN:
        KNOWN.clear()
        KNOWN[name] = Emissions(field)
    return KNOWN[name]


def files(texts: list[str]) -> np.ndarray:
    """Features of whole texts [text, class, feature]."""
    found = [file_features(text) for text in texts]
    return np.array(found, np.int64).reshape(len(texts), CLASSES, len(file_features("")) // CLASSES)


# Tokens and those beside them, as SIDES.
NEIGHBOURS = [(slice(None, -2), slice(2, None)), (slice(None, -1), slice(1, None)),
              (slice(1, None), slice(None, -1)), (slice(2, None), slice(None, -2))]


@dataclass(frozen=True)
class Tokens:
    """All tokens of some texts in order. Two rows 0 part lines, so that no token is beside another line's.

    ``owner`` is a token's text, ``number`` its place among what TOKEN finds there.
    """

    rows: np.ndarray
    owner: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, texts: list[str], words: Words) -> Tokens:
        found = [TOKEN.findall(text) for text in texts]
        sizes = np.array([len(f) + 2 for f in found], np.int64)
        rows = np.zeros(int(sizes.sum()), np.int64)
        starts = np.cumsum(sizes) - sizes
        for f, start in zip(found, starts.tolist()):
            rows[start + 1:start + 1 + len(f)] = np.fromiter(map(words.__getitem__, f), np.int64, len(f))
        back = np.repeat(np.arange(len(rows)), np.where(rows == 0, 2, 1))
        owner = np.repeat(np.arange(len(texts)), sizes)
        return cls(rows[back], owner[back], (np.arange(len(rows)) - 1 - starts[owner])[back])


def word_class(word: str) -> int:
    return 2 if len(word) < LONG else 0 if any(map("0123456789".__contains__, word)) else 1


def word_features(word: str) -> list[int]:
    """Shape of a token, and what it is to its neighbours of each class, as places in the weights."""
    size, chars, beside = max(1, len(word)), set(word), word.lower()[:24].encode("utf-8", "replace")
    digit = list(map(str.isdigit, word))
    digits = sum(digit)
    kinds = "".join([name for name, held in KINDS_OF_CHARS if not held.isdisjoint(chars)])
    long = next((n for n in (64, 40, 32, 24, 20, 16, 12, 8, 6, 4, 2) if size >= n), 1)
    pairs = sum(map(ne, digit, digit[1:])) if digits else 0
    cases = 0 if word.islower() else sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
    letters, head = any(map(str.isalpha, word)), word[:4] if word[:4].isupper() else ""
    shape = shape_features(word_class(word), kinds, long, 4 * digits // size, digits > 0, 8 * pairs // size, 4 * len(chars) // size, letters,
                           8 * cases // size, head)
    return [*shape, *[zlib.crc32(beside, side) % WEIGHTS for side in SIDE_SUMS]]


@lru_cache(CACHE_WORDS)
def shape_features(kind: int, kinds: str, long: int, digits: int, digit: bool, changes: int, different: int, letters: bool,
                   cases: int, head: str) -> list[int]:
    named = [
        "bias", f"long {long}", f"kinds {kinds}", f"kinds {kinds} {long}", f"digits {digits}", f"digit {digit} {long}",
        f"changes {changes}", f"different {different}", f"letters {letters} {long}", f"cases {cases}", f"head {head}",
    ]
    return [zlib.crc32(f"{kind} {name}".encode("utf-8", "replace")) % WEIGHTS for name in named]


def file_features(text: str) -> list[int]:
    """What a text as a whole looks like, to tokens of each class: its length, its share of digits and of signs of assignment."""
    length = max(1, len(text))
    signs = text.count("=") + text.count(":") + text.count('"')
    named = [
        f"file length {length.bit_length() // 2}",
        f"file signs {min(5, 200 * signs // length)}",
        f"file lines {min(5, (50 * text.count(chr(10))) // length)}",
    ]
    return [zlib.crc32(f"{kind} {name}".encode()) % WEIGHTS for kind in range(CLASSES) for name in named]


def runs_of(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edges = np.flatnonzero(np.diff(held.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2] - edges[::2]


def by_length(starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places [run, step] of the runs of one length, for each length."""
    for length in np.unique(lengths).tolist():
        yield starts[lengths == length][:, None] + np.arange(length)


def undecided(move: np.ndarray, emit: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The tokens that may be in a secret; all others are outside in the best path over the whole line, so it parts there.

    Against outside tokens, a stretch of others gains no more than the sum of its tokens' best emissions and moves, and the
    best move out of it. A token is outside for sure if no stretch of its line around it can gain anything.
    """
    inside, stay = [BEGIN, INSIDE], move[OUTSIDE, OUTSIDE]
    gain = emit[:, inside].max(axis=1) - emit[:, OUTSIDE] + (move[:, inside].max() - stay)
    # the two places between lines cost more than any line can gain
    starts, lengths = runs_of(token)
    most = np.add.reduceat(np.maximum(gain, 0) * token, starts).max() if len(starts) else 0.0
    sums = np.cumsum(np.where(token, gain, -1.0 - most))
    least = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
    largest = np.maximum.accumulate(sums[::-1])[::-1]
    return token & (largest - least + (move[inside, OUTSIDE].max() - stay) > -ROUNDING)


def viterbi(move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best states [run, step], with an outside token before and after each run. Of equal paths, the lower state."""
    best = emit[:, 0] + move[OUTSIDE]
    back = []
    for step in range(1, emit.shape[1]):
        ways = best[:, :, None] + move[None]
        back.append(ways.argmax(axis=1))
        best = ways.max(axis=1) + emit[:, step]
    states = [(best + move[:, OUTSIDE]).argmax(axis=1)]
    for pointer in reversed(back):
        states.append(pointer[np.arange(len(pointer)), states[-1]])
    return np.stack(states[::-1], axis=1)


def train(texts: list[str], *, steps: int = 150, rate: float = 0.1, shrink: float = 1e-3) -> Field:
    """Maximum likelihood by Adam over the tokens of ``texts``; what the patterns find is the truth.

    Lines are learnt from in stretches of about STRETCH tokens. Of those with neither a secret nor a long token with a digit, evenly
    spread ones stand for the rest, PLAIN_STRETCHES or fewer, and count accordingly.
    """
    words = Words()
    tokens = Tokens.of(texts, words)
    kinds, known = np.array(words.classes)[tokens.rows], np.array(words.rows)
    truth, telling = np.full(len(kinds), OUTSIDE), (kinds == 0) & (tokens.rows > 0)
    for k in {k for k, text in enumerate(texts) if pattern_spans(text)}:
        secrets = [(a, b) for *_, a, b in pattern_spans(texts[k])]
        places = {m: t.span() for m, t in enumerate(TOKEN.finditer(texts[k])) if t[0] != LINE_END}
        before, last = None, -2
        for i in np.flatnonzero((tokens.owner == k) & (tokens.rows > 0)).tolist():
            a, b = places[int(tokens.number[i])]
            inside = next((s for s in secrets if a < s[1] and s[0] < b), None)
            if inside is not None:
                truth[i] = INSIDE if inside == before and last == i - 1 else BEGIN
                last = i
            before = inside
    telling |= truth != OUTSIDE
    starts, lengths, weights = stretches(tokens, truth, telling)
    beside = np.zeros((len(kinds), len(SIDES)), np.int64)
    for side, (here, there) in enumerate(NEIGHBOURS):
        beside[here, side] = known[tokens.rows[there], SHAPE + CLASSES * side + kinds[here]]
    feats = np.concatenate([known[:, :SHAPE][tokens.rows], beside, files(texts)[tokens.owner, kinds]], axis=1)
    move = np.zeros((3, 3))
    move[OUTSIDE, INSIDE] = -20.0  # a secret begins before it goes on
    params = [np.zeros((WEIGHTS, 3)), move]
    for kind in range(CLASSES):
        params[0][zlib.crc32(f"{kind} bias".encode()) % WEIGHTS, OUTSIDE] = 1.0
    groups = [(feats[places], truth[places], weight) for weight in sorted({*weights.tolist()})
              for places in by_length(starts[weights == weight], lengths[weights == weight])]
    # what shrinks the weights is in proportion to the tokens that tell something
    total = max(1, int(telling.sum()))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1 if groups else 1):
        grads = [-shrink * params[0], np.zeros((3, 3))]
        for feats, truth, weight in groups:
            for grad, part in zip(grads, likelihood_gradient(Field(*params), feats, truth)):
                grad += part * (weight / total)
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        params[1][OUTSIDE, INSIDE] = -20.0
    return Field(*params)


def stretches(tokens: Tokens, truth: np.ndarray, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and weights of the stretches to learn from; no secret is cut."""
    token = tokens.rows > 0
    starts, lengths = runs_of(token)
    first = np.zeros(len(token), np.int64)
    first[starts] = starts
    within = np.arange(len(token)) - np.maximum.accumulate(first)
    cut = token & ((within == 0) | (within % STRETCH == 0) & (truth != INSIDE))
    starts = np.flatnonzero(cut)
    lengths = np.add.reduceat(token.astype(np.int64), starts) if len(starts) else starts
    wanted = np.add.reduceat(telling.astype(np.int64), starts) > 0 if len(starts) else cut[:0]
    plain = np.flatnonzero(~wanted)
    some = plain[::max(1, -(-len(plain) // PLAIN_STRETCHES))]
    taken = np.concatenate([np.flatnonzero(wanted), some])
    weights = np.concatenate([np.ones(int(wanted.sum())), np.full(len(some), len(plain) / max(1, len(some)))])
    return starts[taken], lengths[taken], weights


def likelihood_gradient(field: Field, feats: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood: what is seen less what the field expects, by forward and backward sums."""
    emit = field.emit[feats].sum(axis=2)
    n, length, _ = emit.shape
    fore, back = np.empty_like(emit), np.empty_like(emit)
    fore[:, 0] = emit[:, 0] + field.move[OUTSIDE]
    for t in range(1, length):
        fore[:, t] = np.logaddexp.reduce(fore[:, t - 1, :, None] + field.move[None], axis=1) + emit[:, t]
    back[:, -1] = field.move[:, OUTSIDE]
    for t in range(length - 2, -1, -1):
        back[:, t] = np.logaddexp.reduce(field.move[None] + (emit[:, t + 1] + back[:, t + 1])[:, None], axis=2)
    whole = np.logaddexp.reduce(fore[:, -1] + back[:, -1], axis=1)
    expected = np.exp(fore + back - whole[:, None, None])
    gap = np.eye(3)[truth] - expected
    d_emit = np.zeros_like(field.emit)
    places, each = feats.ravel(), feats.shape[-1]
    for state in range(3):
        d_emit[:, state] = np.bincount(places, np.repeat(gap[:, :, state].ravel(), each), len(d_emit))
    d_move = np.zeros((3, 3))
    np.add.at(d_move[OUTSIDE], truth[:, 0], 1)
    np.add.at(d_move[:, OUTSIDE], truth[:, -1], 1)
    d_move[OUTSIDE] -= expected[:, 0].sum(axis=0)
    d_move[:, OUTSIDE] -= expected[:, -1].sum(axis=0)
    for t in range(1, length):
        np.add.at(d_move, (truth[:, t - 1], truth[:, t]), 1)
        both = fore[:, t - 1, :, None] + field.move[None] + (emit[:, t] + back[:, t])[:, None]
        d_move -= np.exp(both - whole[:, None, None]).sum(axis=0)
    return d_emit, d_move


def scan(field: Field, texts: list[str], known: Emissions | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's secrets, in order: all pattern spans, and the field's where they touch none.

    Every token of every line is judged. ``known`` are the words met so far.
    """
    known = known or Emissions(field)
    base = [pattern_spans(text) for text in texts]
    out = [[span[:3] for span in spans] for spans in base]
    if len(known.words) > KNOWN_WORDS:
        known.clear()
    tokens = Tokens.of(texts, known.words)
    emit = known.of(tokens, texts)
    states = np.full(len(emit), OUTSIDE)
    for places in by_length(*runs_of(undecided(field.move, emit, tokens.rows > 0))):
        states[places] = viterbi(field.move, emit[places])
    hits: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(states != OUTSIDE).tolist():
        joined = states[i] == INSIDE and states[i - 1] != OUTSIDE
        hits.setdefault(int(tokens.owner[i]), []).append((int(tokens.number[i]), joined))
    for k, found in hits.items():
        places = [m.span() for m in TOKEN.finditer(texts[k])]
        spans: list[list[int]] = []
        for number, joined in found:
            a, b = places[number]
            if joined:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        starts, ends = merged(base[k])
        for a, b in spans:
            last = bisect_left(starts, b) - 1  # the last stretch that starts before b
            if last < 0 or ends[last] <= a:
                out[k].append((a, 3, b))
    return [sorted(spans) for spans in out]


def merged(spans: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, sorted by start, cover together."""
    starts, ends = [], []
    for start, _, end, *_ in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def training_texts(docs: DataFrame, text: str) -> list[str]:
    """About TRAIN_WITH texts in which a pattern may match and TRAIN_ANY with a digit, by a hash; equal texts once."""
    t = F.col("t")
    short = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where(
        t.isNotNull() & (F.length("t") <= TRAIN_CHARS)).withColumn("h", F.xxhash64("t"))
    likely = t.rlike(r"(?i)(password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}")
    digit = t.rlike("[0-9]")
    n = short.agg(F.count_if(likely).alias("likely"), F.count_if(digit).alias("digit")).first()
    # the order of the conditions spares most texts the patterns
    wanted = (F.col("likely_hash") & likely) | (F.col("digit_hash") & digit)
    rows = short.withColumns({
        "likely_hash": hash_below(F.col("h"), TRAIN_WITH, n.likely),
        "digit_hash": hash_below(F.col("h"), TRAIN_ANY, n.digit),
    }).where(wanted).select("t").distinct().limit(2 * (TRAIN_WITH + TRAIN_ANY)).collect()
    return sorted(r.t for r in rows)


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end) by start and then kind.

    Kinds ``assign``, ``access`` and ``hex`` are matches of fixed patterns; ``crf`` is what a linear-chain conditional
    random field adds where it touches none of them. Places count code points, the end is exclusive. The field tags
    every token as begin, inside or outside from its shape, the words around it and the text as a whole, and is decoded
    by Viterbi over whole lines. It is trained on the driver, on about TRAIN_WITH + TRAIN_ANY texts (never twice as many) of at most
    TRAIN_CHARS characters; the patterns' own finds are the truth, so it carries their shapes over to other wordings.
    The scan covers every whole text, one pass without a shuffle.

    Null and empty texts have no spans. Repeated rows give equal spans. Other columns are not read. Without any text to
    train on, the field tags nothing.
    """
    field = train(training_texts(docs, text))
    span = StructType([
        StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema["doc_id"],
                         StructField("spans", ArrayType(span))])
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    name = uuid.uuid4().hex

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.decode("utf-8", "replace") for t in as_bytes(batch.column("text"))]
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in scan(field, texts, known_words(field, name))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, spans_type)], ["doc_id", "spans"])

    columns = {"doc_id": F.col(f"`{doc_id}`"), "text": F.col(f"`{text}`").cast("binary")}
    return map_blocks(docs, columns, block, schema, "text")
