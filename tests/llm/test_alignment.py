"""Alignment of two tokenizers' tokens against a plain walk along the bytes."""

import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netlog.llm import alignment
from netlog.llm.queries import ALIGNED, QUERIES

PATHS = [public_tokenizers.path(name) for name in ALIGNED]
SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def bytes_of(models):
    back = {c: b for b, c in enumerate(alignment.BYTE_CHARACTERS)}

    def of_a(i):
        token = models[0].id_to_token(i)
        return token.encode() if i == 50256 else bytes(back[c] for c in token)

    def of_b(i):
        piece = models[1].id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()

    return of_a, of_b


def walk(models, text):
    """(groups, links) of a text, byte by byte: groups of both sides' ids, and the id pair of every overlap."""
    of_a, of_b = bytes_of(models)
    ids = models[0].encode(" " + text, add_special_tokens=False).ids, models[1].encode(text)
    spelled = [b"".join(map(f, i)) for f, i in zip((of_a, of_b), ids)]
    if not text or spelled != [b" " + text.encode()] * 2:
        return [], []
    owner = [[k for k, i in enumerate(own) for _ in f(i)] for f, own in zip((of_a, of_b), ids)]
    links = [(ids[0][i], ids[1][j]) for i, j in sorted(set(zip(*owner)))]
    groups, start = [], [0, 0]
    for at in range(len(owner[0])):
        ends = [at + 1 == len(o) or o[at + 1] != o[at] for o in owner]
        if all(ends):
            stop = [o[at] + 1 for o in owner]
            groups.append(tuple(own[a:b] for own, a, b in zip(ids, start, stop)))
            start = stop
    return groups, links


def plain(models, rows):
    walked = [walk(models, text or "") for _, text in rows]
    counts = Counter(p for _, links in walked for p in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (k, _), (groups, links) in zip(rows, walked):
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((k, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def aligned(df):
    made = alignment.align(df, *PATHS)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment.count_links(made.withColumn("groups_sha256", digest).drop("groups"), alignment.piece_count(PATHS[1])).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


ROWS = [(1, "Hello, world"), (2, None), (3, ""), (4, " "), (5, "  two  spaces\n\n\ttabs "), (6, "é ß 🙂🙃 日本語 ᚠ"), (7, "<|endoftext|> <s> </s> <unk>"),
        (8, "a ▁ piece mark"), (9, "nul \0 byte"), (None, "Hello, world"), (None, None), (1, "Hello, world"), (1, "other"),
        (10, "long words " * 20_000), (11, "x" * 3_000), (12, "́combining é"), (13, "<0x41> \r\n\x0b")]


def test_edges(spark, models):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns(
        {c: F.lit("x") for c in ("n_a", "pairs", "pair", "times", "n", "_row", "groups", "best", "a")})
    assert sorted((tuple(r) for r in aligned(df).collect()), key=repr) == plain(models, ROWS)
    assert aligned(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
def test_query(spark, models):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_merge_path"](spark, SF_DIR).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(models, rows)


def test_counts_beyond_the_broadcast(spark, models, monkeypatch):
    rows = [(i, f"some words {i % 7} and number {i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (0, 4, 12):
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
        assert sorted((tuple(r) for r in aligned(df).collect()), key=repr) == plain(models, rows)


ENDS = st.sets(st.integers(1, 60), max_size=40)


@settings(deadline=None)
@given(ENDS, ENDS, st.integers(1, 9))
def test_pieces_of_any_size_give_the_same(ends_a, ends_b, steps):
    a, b = (np.array(sorted(e | {61}), np.int64) for e in (ends_a, ends_b))
    i, j = alignment.merge_paths(a, b, steps)
    assert all(x + y == min(p * steps, len(a) + len(b)) for p, (x, y) in enumerate(zip(i.tolist(), j.tolist())))
    met = alignment.overlaps(a, b, steps)
    owner = [np.searchsorted(e, np.arange(1, 62)).tolist() for e in (a, b)]
    assert list(zip(met.a.tolist(), met.b.tolist())) == sorted(set(zip(*owner)))
    assert met.common.tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@settings(deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab .,'\n\t  ▁é0日")), max_size=60))
def test_segments_encode_as_the_whole_text_does(models, text):
    pair = alignment.pair_of(*(open(path, "rb").read() for path in PATHS))
    assert pair.cuts
    (a,), (b,) = pair.encode([text.encode()])
    if len(a):
        assert a.tolist() == models[0].encode(" " + text, add_special_tokens=False).ids and b.tolist() == models[1].encode(text)
    else:
        assert walk(models, text) == ([], [])
