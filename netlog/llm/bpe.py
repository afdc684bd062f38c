"""Byte-level BPE: a rank file becomes a sentencepiece model, which encodes pre-tokens; ids decode by inverse mapping.

The vocabulary is written straight into sentencepiece's model format. Each token's bytes are mapped to one printable
character each, its score is its negative rank, so the merge with the lowest rank is done first, and the normaliser is
the identity. The model is never trained.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .text import as_bytes

# Entries of a process's cache of pre-tokens; beyond it the cache starts anew.
CACHE_PRETOKENS = 60_000
# Matches of a long text that are held at a time.
MATCHES_HELD = 1 << 18


def byte_characters() -> str:
    """One printable character for each of the 256 bytes: itself where Latin-1 prints it, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


BYTE_CHARACTERS = byte_characters()


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in order of rank. Raises ValueError if the ranks are not 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialize_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ``i`` is ``tokens[i]``, byte by byte, with score ``-i``.

    Fields by number: a piece has text 1, score 2, type 3; the trainer's settings have model type 3, vocabulary size 4
    and ids of special pieces 40 to 43; the normaliser's have name 1 and three flags 3 to 5.
    """

    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def number(field: int, n: int) -> bytes:
        return varint(field << 3) + varint(n)

    def chunk(field: int, data: bytes) -> bytes:
        return varint(field << 3 | 2) + varint(len(data)) + data

    def piece(text: str, score: float, kind: int) -> bytes:
        return chunk(1, chunk(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece("".join(BYTE_CHARACTERS[b] for b in t), -float(i), normal) for i, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    trainer = number(3, bpe) + number(4, len(pieces)) + number(40, len(tokens))
    trainer += b"".join(number(field, -1) for field in (41, 42, 43))
    normalizer = chunk(1, b"identity") + b"".join(number(field, 0) for field in (3, 4, 5))
    return b"".join(pieces) + chunk(2, trainer) + chunk(3, normalizer)


class Codec(dict):
    """Encodes and decodes with one model. As a dict: pre-token to its ids, packed as little-endian 32-bit integers."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: bytes([b]) for b, c in enumerate(BYTE_CHARACTERS)}
        count = self.model.get_piece_size() - 1
        self.tokens = [b"".join(back[c] for c in self.model.id_to_piece(i)) for i in range(count)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) >= CACHE_PRETOKENS:
            self.clear()
        data = pretoken.encode("utf-8", "replace")
        # a pre-token that is a token stays whole, even if no chain of merges leads to it
        if (rank := self.whole.get(data)) is not None:
            ids = [rank]
        else:
            ids = self.model.encode(data.decode("latin-1").translate(BYTE_CHARACTERS))
        value = self[pretoken] = np.asarray(ids, "<u4").tobytes()
        return value

    def encode(self, text: str) -> bytes:
        if len(text) < MATCHES_HELD:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        found, parts = self.pattern.finditer(text), []
        while part := b"".join([self[m.group()] for m in islice(found, MATCHES_HELD)]):
            parts.append(part)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def codec(model: bytes, pattern: str) -> Codec:
    """Kept in the worker process, so that later tasks find the model loaded."""
    return Codec(model, pattern)


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: the text's token ids as packed little-endian unsigned 32-bit integers (binary).

    ``pattern`` cuts the text into pre-tokens, each encoded alone; there are no special tokens. One pass over the
    rows, no shuffle; a text costs memory in proportion to its own length. Null and empty texts give empty ids. Ids
    come out the same for repeated rows. A column that is already called ``ids`` is replaced; others stay as they are.
    """
    return _mapped(docs, ranks_path, pattern, text, {ids: lambda tool, data: tool.encode(_text(data))})


def decode_bpe(docs: DataFrame, ranks_path: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the bytes (binary) of packed ``ids``, by the inverse of the byte mapping.

    Null ids give no bytes. An id beyond the vocabulary, or bytes that are not a multiple of four, raise an error.
    """
    return _mapped(docs, ranks_path, pattern, ids, {out: Codec.decode})


def recode_bpe(
    docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", ids: str = "ids", out: str = "decoded",
) -> DataFrame:
    """``docs`` with ``ids`` as :func:`encode_bpe` makes them and ``out``, the bytes that those ids decode to.

    Both in one pass, so that a task needs one Python worker and one model. Null and empty texts give empty ids and no
    bytes.
    """
    return _mapped(docs, ranks_path, pattern, text, {ids: lambda tool, data: tool.encode(_text(data)), out: Codec.decode})


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _mapped(docs, ranks_path, pattern, source, made):
    """``docs`` with the columns of ``made``: the first from ``source``, each further one from the column before it."""
    model = docs.sparkSession.sparkContext.broadcast(serialize_model(read_ranks(ranks_path)))
    kept = [c for c in docs.columns if c not in made]
    cols = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").cast("binary").alias("\0in"))
    schema = StructType([docs.schema[c] for c in kept] + [StructField(out, BinaryType()) for out in made])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model.value, pattern)
        for batch in batches:
            columns, column = batch.columns[:len(kept)], batch.column(len(kept))
            for method in made.values():
                column = pa.array([method(tool, value) for value in as_bytes(column)], pa.binary())
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, [*kept, *made])
        # the worker goes on to other stages: it keeps the model and gives back what texts took
        tool.clear()
        pa.default_memory_pool().release_unused()

    return cols.mapInArrow(run, schema)
