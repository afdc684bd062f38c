"""Each stage of the pipeline on what the one before it kept."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netlog.llm import minhash, toxicity
from netlog.llm.queries import held_out

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    texts = {name: {r.doc_id: r.text for r in df.collect()} for name, df in kept.items() if name != "byte_bpe"}
    everything = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(~held_out("doc_id"))
    scores = toxicity.score_toxicity(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)
    assert texts["toxicity"] == {r.doc_id: everything[r.doc_id] for r in scores.where("score < 0.3").collect()}
    lines = texts["line_dedup"]
    assert all(set(t.split("\n")) <= set(texts["toxicity"][k].split("\n")) for k, t in lines.items())
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].collect() if r.text != everything[r.doc_id])
    first = {r.doc_id for r in minhash.near_duplicates(kept["line_dedup"]).where("kept").collect()}
    assert texts["near_dedup"] == {k: lines[k] for k in first}
    assert set(texts["mixing"]) <= set(texts["near_dedup"])
    times = kept["mixing"].groupBy("doc_id").count()
    assert times.where("count > 3").isEmpty()
    tokens = kept["byte_bpe"]
    assert tokens.count() == kept["mixing"].count() and tokens.where("NOT round_trip").isEmpty()


EDGES = [
    (1, "a line that is here\nand one that follows it", "en", "a", 45), (2, "a line that is here\nand one that follows it", "en", "a", 45),
    (2, "a line that is here\nand one that follows it", "en", "a", 45), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, " \t\n", None, "b", 3), (None, "no id here\nat all", "en", None, 17), (None, None, None, None, None),
    (6, "word " * 50_000, "en", "c", 250_000), (7, "tie", "en", "c", 3), (8, "tie", "en", "c", 3), (9, "nul \0 é🙂", "en", "a", 8),
]
CLASH = ["_runs", "runs", "component_id", "kept", "copies", "size", "ids", "_row", "_id", "score", "n_tokens", "round_trip"]


def test_edges_of_every_stage(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("other") for c in CLASH}).repartition(3)
    known = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF_DIR).count() == 0
        out = stage(spark, docs, SF_DIR)
        rows = out.collect()
        if name == "byte_bpe":
            assert len(rows) == len(EDGES) and all(r.round_trip for r in rows)
            assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
            continue
        assert out.columns == docs.columns and {r[c] for r in rows for c in CLASH} <= {"other"}
        if name == "line_dedup":  # the second and third row are copies of the first, and go
            assert sorted((r.doc_id, r.text) for r in rows if r.doc_id and r.doc_id < 5) == [
                (1, EDGES[0][1]), (3, None), (4, "")] and len(rows) == len(EDGES) - 2
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 3, 4, 5, 6, 7, 9] and len(rows) == len(EDGES) - 3
        elif name == "mixing":
            assert {(r.doc_id, r.text) for r in rows} <= known
        else:
            assert len(rows) == len(EDGES)
