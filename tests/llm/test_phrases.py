"""Phrase mining against plain counting of every text, and prefix-free parsing piece by piece."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netlog.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counted(rows, max_words):
    counts = Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            for k in range(1, max_words + 1):
                counts.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return counts


def plain(rows, least, top=2000, max_words=3, inside=50):
    counts = counted(rows, max_words)
    found = {(lang, p): a for (lang, p), a in counts.items() if len(p) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i:i + k]] = max(longer[lang, p[i:i + k]], a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * longer[lang, p] >= inside * a and longer[lang, p]:
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    words = Counter()
    for (lang, p), a in counts.items():
        words[lang] += a if len(p) == 1 else 0
    return sorted((lang, i + 1, p.decode(), -a, l, r, words[lang], -s)
                  for lang, each in out.items() for i, (s, a, p, l, r) in enumerate(sorted(each)[:top]))


def made(seed, count=150):
    """Texts of few words, so that phrases repeat; shared passages; pieces of every length."""
    rng = random.Random(seed)
    words = ["The", "of", "new", "York", "é", "x1", "ß", "a\0b", "city", "STATE", "🙂"]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(rng.randrange(40)))
        rows.append((i, text + (shared if i % 3 == 0 else ""), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, None, None), (1, "", "en"), (2, " \t\n..", "en"), (3, "long " * 50_000, "fr")]


@pytest.mark.parametrize("max_words, least", [(3, 10), (2, 3), (4, 5)])
def test_against_counting(spark, max_words, least):
    rows = made(max_words)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("chunk", "n", "words", "part", "rank")})
    got = phrases.collocations(df, max_words=max_words, least=least)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, max_words=max_words)


def test_ties_and_top(spark):
    rows = [(i, f"w{i % 30} v{i % 30}", "en") for i in range(600)]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA), top=7).collect())
    assert got == plain(rows, 10, top=7) and [r[1] for r in got] == list(range(1, 8))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(df).collect() == []


def test_chunks_meet_at_windows_and_overlaps_count_once(spark):
    rows = made(9, 60)
    df = spark.createDataFrame(rows, SCHEMA).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    chunks = phrases.parse(df, 2)
    starts = sum(r.starts * r.n for r in chunks.collect())
    assert starts == sum(len(w) for _, t, _ in rows for w in pieces(t))
    for least in (1, 4):
        got, shorter = {}, None
        for size in (1, 2, 3):
            shorter = phrases.count_phrases(chunks, size, least, shorter)
            got |= {(r.lang, tuple(r.phrase.split(" "))): r.n for r in shorter.collect()}
        assert got == {p: n for p, n in counted(rows, 3).items() if n >= least}


def test_equal_passages_give_equal_chunks():
    passage = " ".join(f"p{i}" for i in range(800))
    a, b = (phrases.chunks_of([start + passage.encode() + b" end"], 2)[1] for start in (b"", b"other words before "))
    assert len(set(a) & set(b)) > 0.8 * len(a) > 10


def test_scores_beyond_64_bits(spark):
    expr = F.expr("(cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * 1000000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    a, l, r = 900_000_000_000_001, 900_000_000_000_007, 900_000_000_000_003
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(expr).first()[0] == 10**6 * a * a // (l * r)
