"""Every query of the operators over whole small tables: against SQL, or against a plain version in Python."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from netlog.llm.oracle import SQL
from netlog.llm.queries import QUERIES, RANKS

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def rows(spark, name):
    return sorted(QUERIES[name](spark, SF_DIR).collect())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF_DIR), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(
        (tuple(r[i] for i in places) for r in want.fetchall()), key=repr)


def test_op1(spark, docs):
    first, want = {}, []
    for k, text in docs:
        words = (text or "").encode().split()
        grams = [tuple(words[i:i + 13]) for i in range(len(words) - 12)]
        gone = {i + j for i, g in enumerate(grams) if g in first for j in range(13)}
        want.append((k, len(words), len(gone), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
        for g in grams:
            first.setdefault(g, k)
    assert [tuple(r) for r in rows(spark, "op1_suffix_automata")] == want
    assert any(r[2] for r in want)


def test_op2(spark, docs):
    got = rows(spark, "op2_pseudo_likelihood")
    assert [(r.doc_id, r.n_words) for r in got] == [(k, len((t or "").encode().split())) for k, t in docs]
    assert all(r.log_prob < 0 and r.mean_log_prob == pytest.approx(r.log_prob / r.n_words) for r in got if r.n_words)


def test_op3(spark, docs):
    got = rows(spark, "op3_iblt_fingerprint")
    prints = {}
    for r, (k, text), (_, after) in zip(got, docs, docs[1:] + docs[:1]):
        cut = len(text) // 4
        assert (r.doc_id, r.n_chars) == (k, len(text))
        assert r.edited_sha256 == sha((text[:len(text) - cut] + after[:cut]).encode())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def test_op5(spark, con):
    got = {r.doc_id: r for r in rows(spark, "op5_nearest_toxicity")}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    labels = con.sql("SELECT doc_id, toxic FROM labels").fetchall()
    toxic, clean = ([got[k].score for k, y in labels if y == want] for want in (1, 0))
    assert np.mean(toxic) > np.mean(clean)


def test_op7(spark, docs):
    sets = {}
    for k, text in docs:
        words = (text or "").encode().lower().split()
        sets[k] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    group = {k: k for k in sets}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group.update({k: low for k, g in group.items() if g == high})
    assert [tuple(r) for r in rows(spark, "op7_minhash")] == [(k, len(sets[k]), group[k], group[k] == k) for k in keys]


def test_op8(spark, docs):
    path = public_tokenizers.path(RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, (k, text) in zip(rows(spark, "op8_byte_bpe"), docs):
        ids = enc.encode_ordinary(text)
        assert tuple(r) == (k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))


def test_op9(spark, con):
    got = rows(spark, "op9_adaptive_scan")
    vectors = con.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchnumpy()
    ids, x = vectors["vec_id"], np.stack(vectors["embedding"]).astype(float)
    found = total = 0
    for q in ids[ids % 20 == 0]:
        scores = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in mine] == list(range(1, len(order) + 1))
        assert all(r.score == pytest.approx(scores[ids == r.vec_id][0], abs=1e-12) for r in mine)
        found += len({r.vec_id for r in mine} & set(ids[order].tolist()))
        total += len(order)
    assert found >= 0.9 * total


def test_op10(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r, (k, text) in zip(rows(spark, "op10_crf_secrets"), docs):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        joined = ",".join(f"{('assign', 'access', 'hex')[b]}:{a}:{e}" for a, b, e in sorted(spans))
        counts = tuple(sum(s[1] == kind for s in spans) for kind in range(3))
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (k, *counts, sha(joined.encode()))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
