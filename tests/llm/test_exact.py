"""Exact duplicates against a plain version: edges, ties, hot groups, refinement step by step."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from netlog.llm import exact
from netlog.operators.bitfilter import bit_filter, with_filter

SCHEMA = "doc_id long, text string"


def plain(rows):
    """(doc_id, keep_id, group_size, digest) of every row, and how many rows of each text stay."""
    groups = {}
    for k, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", text or ""), []).append((-len(text or ""), k is None, k or 0, k))
    out = []
    for bare, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr), len(groups)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact.exact_duplicates(df, every_digest=True).collect()
    want, groups = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.digest for r in kept}) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_edges(spark):
    long = "word " * 100_000
    check(spark, [
        (1, "a b"), (2, "ab"), (3, "a  b"), (4, "a b"), (5, None), (6, ""), (7, " \t\n\v\f\r"), (8, long), (9, long + "x"),
        (10, "x" + long), (11, long.upper()), (None, "ab"), (None, "ab "), (2, "ab"), (2, "ab"), (12, "é🙂"), (13, "é 🙂"), (14, "nul\0"),
        (15, "nul"), (16, long), (3, "other"),
    ])


def test_same_length_and_beginning_differ_later(spark):
    start = "s" * 400
    rows = [(i, f"{start}{i % 7}") for i in range(30)]
    check(spark, rows)
    lone = exact.exact_duplicates(spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "abd"), (4, "ab")], SCHEMA))
    # whole texts are hashed only where length and beginning occur again
    assert {r.doc_id for r in lone.where("digest IS NOT NULL").collect()} == {1, 4}


def test_hot_group(spark):
    rows = [(i, "copy  of it" if i % 3 == 0 else f"text {i % 2000}") for i in range(6_000)]
    check(spark, rows)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA).withColumns(
        {c: F.lit("x") for c in ("n_chars", "length", "again", "digest", "row", "bare", "_b", "_bits", "best")})
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact.exact_duplicates(df).collect()) == [(1, 1, True), (2, 1, False)]
    assert exact.exact_duplicates(df.where("false")).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.text("ab \n\té", max_size=4))),
                min_size=1, max_size=30))
def test_any_rows(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("bits", [15, 20])
def test_bit_filter_misses_nothing(spark, bits):
    keys = spark.range(5_000).select(F.xxhash64("id").alias("h"), (F.col("id") % 2 == 0).alias("even"))
    told = with_filter(keys, "h", bit_filter(keys.where("even"), "h", bits), "told", bits)
    assert told.where("even AND NOT told").isEmpty()
    # others are told apart unless they share a bit
    assert told.where("NOT even AND told").count() < 2_500 * 2_500 / (1 << bits) * 1.5 + 10
