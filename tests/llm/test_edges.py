"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns of clashing names."""


import public_tokenizers
import pytest
from pyspark.sql import functions as F

from netlog.llm import ann, bpe, iblt, lines, lm, minhash, mixing, secrets, substrings, toxicity
from netlog.llm.queries import RANKS
from netlog.llm.text import word_count

PATTERN = public_tokenizers.PATTERN
LONG = " ".join(f"word{i % 5000}" for i in range(200_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators use inside or return
CLASH = ["size", "band", "rank", "key", "doc", "version", "score", "copies", "ids", "runs", "h1", "rep", "label", "v", "target"]
SHARED = " ".join(f"common{i}" for i in range(20))
ROWS = [
    (1, f"{SHARED} first tail", "en", "a", 10), (2, f"head {SHARED}", None, "a", None), (2, f"head {SHARED}", None, "a", None),
    (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n ", "en", "b", 4), (6, "é ß 🙂 x", "de", None, 8),
    (None, f"{SHARED} null id", "en", "a", 3), (None, None, None, None, None), (7, LONG, "en", "c", len(LONG)),
    (8, "same tie", "en", "c", 8), (9, "same tie", "en", "c", 8), (10, "nul \0 byte", "en", "a", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("other") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def ids():
    return sorted((r[0] for r in ROWS), key=repr)


def test_substrings(docs, none):
    out = {k: (n, gone, kept) for k, n, gone, kept in by_id(substrings.remove_repeats(docs), "n_words", "n_removed", "kept")
           if k is not None}
    assert out[1][1] == 0 and out[2] == (21, 20, bytearray(b"head")) and out[3] == (0, 0, bytearray()) and out[5][0] == 0
    assert out[7][0] == 200_000 and out[7][1] == 0
    assert {(r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).where("doc_id IS NULL").collect()} == {(22, 0), (0, 0)}
    assert substrings.remove_repeats(none).count() == 0


def test_language_model(docs, none):
    out = dict((r[0], r[1:]) for r in by_id(lm.score_documents(docs), "n_words", "log_prob", "mean_log_prob"))
    assert out[3] == out[4] == out[5] == (0, 0.0, None) and out[7][0] == 200_000 and out[8] == pytest.approx(out[9])
    assert lm.score_documents(none).count() == 0


def test_fingerprints(spark, docs, none):
    out = iblt.fingerprint_versions(docs)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == ids()
    rows = {r.doc_id: r for r in out.where("doc_id > 2").collect()}
    assert rows[3].n_chars == 0 and rows[3].near_edited == 1 and rows[3].near_next == 1
    assert rows[8].fingerprint == rows[9].fingerprint and rows[8].near_next == 1
    one = iblt.fingerprint_versions(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert bytes(one.edited) == b"abcdefab" and one.near_next == 1
    assert iblt.fingerprint_versions(none).count() == 0


def test_mixing(docs, none):
    mixed = mixing.systematic_mix(docs, word_count(F.col("text")))
    out = mixed.collect()
    assert sorted((r.doc_id for r in out), key=repr) == ids() and all(0 <= r.copies <= 3 for r in out)
    assert {r.size for r in out if r.doc_id in (3, 4, 5)} == {0}
    assert sorted(map(tuple, mixing.systematic_mix(docs, word_count(F.col("text"))).collect()), key=repr) == sorted(
        map(tuple, out), key=repr)
    emitted = mixing.emit_copies(docs, mixed)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in out)
    assert mixing.systematic_mix(none, word_count(F.col("text"))).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (8, 1), (9, 0), (99, 1), (4, 7)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels)
    assert [r[0] for r in by_id(out)] == ids() and all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.score_toxicity(none, labels).count() == 0
    kept = toxicity.reject_toxic(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_toxic_words_are_learnt(spark):
    texts = [(i, f"some plain words {i} here" + (" nastyword" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    assert all((out[i].score >= 0.3) == (i % 4 == 0) for i in range(200))
    assert all(e.label == 1 and e.cosine == pytest.approx(1) for e in out[104].evidence)
    assert toxicity.reject_toxic(df, labels).count() == 150


def test_lines(spark, docs, none):
    out = lines.drop_repeated_runs(docs)
    assert by_id(out, "text") == sorted(((r[0], r[1]) for r in ROWS), key=repr)  # single short lines repeat nothing
    texts = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, "b\na"), (5, "z\nz\nz"), (None, "c\nd"), (6, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("runs", F.lit(1))
    got = dict(by_id(lines.drop_repeated_runs(df), "text"))
    # the null id is the first of all, so it keeps its lines
    assert got == {1: "a\nb", 2: "x\ny", 3: "", 4: "b\na", 5: "z", None: "c\nd", 6: None}
    wide = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, wide), (2, f"p\n{wide}\nq"), (3, wide), (3, wide)], "doc_id long, text string")
    assert by_id(lines.drop_repeated_runs(df), "text") == [(1, wide), (2, "p\nq"), (3, ""), (3, "")]
    assert lines.drop_repeated_runs(none).count() == 0


def test_near_duplicates(docs, none):
    out = dict((r[0], r[1:]) for r in by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") if r[0])
    assert out[3] == (0, 3, True) and out[4] == (0, 4, True) and out[8] == (1, 8, True) and out[9] == (1, 8, False)
    assert out[2][1:] == (1, False) and minhash.near_duplicates(docs).count() == len(ROWS)
    assert {r.kept for r in minhash.near_duplicates(docs).where("doc_id IS NULL").collect()} == {True}
    assert minhash.keep_one_of_each(docs).count() == len(ROWS) - 3
    assert minhash.near_duplicates(none).count() == 0


def test_bpe(docs, none):
    path = public_tokenizers.path(RANKS)
    out = bpe.decode_bpe(bpe.encode_bpe(docs, path, PATTERN), path, PATTERN)
    for row in out.collect():
        assert bytes(row.decoded).decode() == (row.text or "") and (len(row.ids) > 0) == bool(row.text)
        assert row.score == "other"
    assert bpe.encode_bpe(none, path, PATTERN).count() == 0


def test_nearest(spark):
    good = [1.0, 0.0, 0.0, 0.0]
    rows = [(0, good), (1, good), (2, good), (2, [0.5, 0.0, 0.0, 0.0]), (3, [0.0] * 4), (4, None), (5, [1.0, None, 0.0, 0.0]),
            (6, [float("nan"), 0.0, 0.0, 0.0]), (7, [float("inf"), 0.0, 0.0, 0.0]), (8, [1.0]), (9, [-1.0, 0.0, 0.0, 0.0]),
            (None, good), (20, [0.0, 2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("list", F.lit(2))
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.nearest(df, df.where("vec_id = 0")).count() == 4
    assert ann.nearest(df.where("false"), df).count() == 0


def test_secrets(spark, docs, none):
    assert {len(r.spans) for r in secrets.find_secrets(docs).collect()} == {0}
    text = f"é password: 'abcdefgh1' AKIA{'A1' * 8} {'0af' * 11}"
    df = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string").withColumn("spans", F.lit(0))
    out = secrets.find_secrets(df).orderBy("doc_id").collect()
    assert [(s.kind, text[s.start:s.end]) for s in out[0].spans if s.kind != "crf"] == [
        ("assign", "password: 'abcdefgh1"), ("access", f"AKIA{'A1' * 8}"), ("hex", "0af" * 11)]
    assert out[0].spans == out[1].spans and out[2].spans == []
    assert secrets.find_secrets(none).count() == 0
