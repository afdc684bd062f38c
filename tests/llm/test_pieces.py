"""The operators' inner pieces against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from netlog.llm import ann, iblt, lm, minhash, mixing, secrets, substrings, toxicity


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(200):
        sequences = [[rng.choice("abc") for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(2, 6))]
        automaton = substrings.SuffixAutomaton()
        for document, sequence in enumerate(sequences):
            automaton.add(sequence, 10 - document)
        automaton.finish()
        for sequence in sequences:
            got = automaton.least_documents(sequence, 4)
            want = [min(10 - d for d, s in enumerate(sequences)
                        if any(s[j:j + 4] == sequence[i:i + 4] for j in range(len(s) - 3)))
                    for i in range(len(sequence) - 3)]
            assert got == want


def test_hot_anchors_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(30))
    docs = [(i, f"{' '.join(rng.choice('abcdefgh') * 3 + str(rng.randint(0, 99)) for _ in range(20))} {shared} x{i} y{i}")
            for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(tuple, substrings.remove_repeats(df).collect()))
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", 5)
    assert sorted(map(tuple, substrings.remove_repeats(df).collect())) == plain
    assert all(r[2] >= 30 for r in plain[1:]) and plain[0][2] == 0


def test_hot_shards_of_distinct_segments_are_bounded(spark, monkeypatch):
    """A passage that every document enters from a context of its own; documents before and after have it too."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(30)]
    docs = []
    for i in range(80):
        cut = rng.randint(0, 5)
        docs.append((i, [f"{c}{i}" for c in "abcdefghij"] + shared[cut:30 - rng.randint(0, 5)] + [f"{c}{i % 9}" for c in "klmnopqr"]))
    first, want = {}, []
    for k, words in docs:
        grams = [tuple(words[i:i + 13]) for i in range(len(words) - 12)]
        want.append((k, len({i + j for i, g in enumerate(grams) if first.get(g, k) < k for j in range(13)})))
        for g in grams:
            first.setdefault(g, k)
    df = spark.createDataFrame([(k, " ".join(words)) for k, words in docs], "doc_id long, text string")
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", 5)
    built, split = [], substrings.by_shard_size

    def recorded(distinct):
        built.append(split(distinct))
        return built[-1]

    monkeypatch.setattr(substrings, "by_shard_size", recorded)
    for bound in (1, 1_000, 1 << 20):
        monkeypatch.setattr(substrings, "SHARD_BYTES", bound)
        got = substrings.remove_repeats(df).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == want
        small, large = built[-1]
        sizes = [r.n for r in small.groupBy("key").agg(F.sum(F.octet_length("segment")).alias("n")).collect()]
        assert max(sizes, default=0) <= bound and large.isEmpty() == (bound == 1 << 20)


def test_sketch_differences():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) + str(rng.randint(0, 300)) for _ in range(rng.randint(0, 400)))
             for _ in range(40)]
    left = iblt.Digests([t.encode() for t in texts])
    right = iblt.Digests([iblt.edited(t, u).encode() for t, u in zip(texts, texts[1:] + texts[:1])])
    each = np.arange(len(texts))
    got = iblt.likeness(left, each, right, each)
    for i in each:
        a, b = (set(d.take(each[[i]])[0].tolist()) for d in (left, right))
        assert got[i] == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(10, 40)]
    star = [(100, i) for i in range(101, 140)]
    got = dict(minhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 140)}}


def test_blocks_find_links_that_leaders_leave(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    docs = [(0, " ".join(base))]
    for i in range(1, 80):
        words = list(base)
        for j in rng.sample(range(100), 2 + i % 5):
            words[j] = f"z{i}_{j}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    usual = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 16)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == usual
    sets = {k: {tuple(t.split()[i:i + 5]) for i in range(96)} for k, t in docs}
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group.update({k: low for k, g in group.items() if g == high})
    assert {r[0]: r[2] for r in usual} == group


def test_gradient_of_the_window_network():
    rng = np.random.default_rng(0)
    target = rng.integers(0, lm.CLASSES, 200).astype(np.int16)
    around = lm.windows(target, np.array([120, 80]))
    network = lm.Network()
    grad = network.gradient(around, target)
    for i in np.argsort(-np.abs(grad))[:5]:
        up, down = lm.Network(network.flat.astype(float)), lm.Network(network.flat.astype(float))
        up.flat[i] += 1e-2
        down.flat[i] -= 1e-2
        slope = (up.log_probabilities(around, target).mean() - down.log_probabilities(around, target).mean()) / 2e-2
        assert grad[i] == pytest.approx(slope, rel=0.05)


def test_order_matters_to_the_language_model(spark):
    rng = random.Random(5)
    phrases = ["the cat sat on a mat", "my dog ran to the park", "one two three four five six"]
    texts = [" ".join(rng.choice(phrases) for _ in range(60)) for _ in range(60)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts + mixed)), "doc_id long, text string")
    score = {r.doc_id: r.mean_log_prob for r in lm.score_documents(df).collect()}
    assert np.mean([score[i] for i in range(10)]) > np.mean([score[60 + i] for i in range(10)]) + 0.3


def test_gradient_of_the_field():
    rng = np.random.default_rng(1)
    feats, truth = rng.integers(0, 20, (6, 3, 4)), rng.integers(0, 3, (6, 3))

    def likelihood(emit, move):
        total = 0.0
        for f, y in zip(feats, truth):
            e = emit[f].sum(axis=1)

            def weight(path):
                places = [secrets.OUTSIDE, *path, secrets.OUTSIDE]
                return e[range(3), path].sum() + sum(move[a, b] for a, b in zip(places, places[1:]))

            paths = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
            total += weight(list(y)) - np.logaddexp.reduce([weight(list(p)) for p in paths])
        return total

    emit, move = rng.normal(size=(20, 3)), rng.normal(size=(3, 3))
    d_emit, d_move = secrets.likelihood_gradient(secrets.Field(emit, move), feats, truth)
    for where, grad in ((emit, d_emit), (move, d_move)):
        for i, j in [(0, 0), (1, 2), (2, 1)]:
            where[i, j] += 1e-5
            up = likelihood(emit, move)
            where[i, j] -= 2e-5
            down = likelihood(emit, move)
            where[i, j] += 1e-5
            assert grad[i, j] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_field_adds_what_no_pattern_finds():
    rng = random.Random(6)

    def code(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    known = [f"set the value\npassword = \"{code(40)}\" here and on" for _ in range(60)]
    plain = [f"order 2024-{rng.randint(10, 99)}-{rng.randint(10, 99)}x went to room b{rng.randint(1000000, 9999999)}" for _ in range(60)]
    field = secrets.train(known + plain)
    text = f"the key is \"{code(20)}{code(11).upper()}\" okay"
    (found,) = secrets.scan(field, [text])
    assert [secrets.KINDS[k] for _, k, _ in found] == ["crf"]
    assert secrets.scan(field, plain[:5]) == [[]] * 5


def test_field_finds_secrets_without_digits_and_short_ones():
    rng = random.Random(7)

    def key(n):
        return "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    words = "order room went came with the long river people Monday Berlin and or yesterday international".split()
    known = [f"set the value\npassword = \"{key(24)}\" here and on" for _ in range(60)]
    plain = [" ".join(rng.choices(words, k=30)) for _ in range(60)]
    field = secrets.train(known + plain)
    hidden = key(24)
    text = f"{' '.join(rng.choices(words, k=30))}\nthe value is \"{hidden}\" here and on"
    assert secrets.scan(field, [text]) == [[(text.index(hidden), 3, text.index(hidden) + 24)]]
    # a token of a few letters where only a secret can stand
    short = [f"pin >{key(2)}< password = {key(9)}" for _ in range(5)]
    named = secrets.train([f"password = {key(9)} ok" for _ in range(60)] + plain)
    assert all(any(k == 0 for _, k, _ in spans) for spans in secrets.scan(named, short))
    assert secrets.scan(field, plain[:5]) == [[]] * 5


@pytest.mark.parametrize("seed", range(5))
def test_every_token_gets_its_state_from_the_whole_line(seed):
    rng = np.random.default_rng(seed)
    lines = [["token%d" % rng.integers(0, 200) if rng.random() < 0.6 else "ab" for _ in range(rng.integers(1, 40))] for _ in range(20)]
    texts = ["\n".join(" ".join(line) for line in lines[:10]), "", "\n\n".join(" ".join(line) for line in lines[10:])]
    move = rng.normal(size=(3, 3))
    move[secrets.OUTSIDE, secrets.INSIDE] = -20.0
    emit = rng.normal(size=(secrets.WEIGHTS, 3))
    field = secrets.Field(emit, move)

    def parts(words, i):
        kind = secrets.word_class(words[i])
        beside = [(words[i + d] if 0 <= i + d < len(words) else "") for d in secrets.SIDES]
        beside = [secrets.word_features(w)[secrets.SHAPE + 3 * k + kind] for k, w in enumerate(beside)]
        whole = secrets.file_features(text)
        return [*secrets.word_features(words[i])[:secrets.SHAPE], *beside, *whole[3 * kind:3 * kind + 3]]

    wanted = []
    for text in texts:
        spans, start = [], 0
        for line in text.split("\n"):
            words = line.split()
            if words:
                feats = np.array([parts(words, i) for i in range(len(words))])
                (states,) = secrets.viterbi(move, emit[feats].sum(axis=1)[None])
                at = start
                for i, (word, state) in enumerate(zip(words, states.tolist())):
                    if state == secrets.BEGIN:
                        spans.append((at, 3, at + len(word)))
                    elif state == secrets.INSIDE:
                        spans[-1] = (spans[-1][0], 3, at + len(word))
                    at += len(word) + 1
            start += len(line) + 1
        wanted.append(spans)
    assert secrets.scan(field, texts) == wanted and any(wanted)


def test_targets_fill_up_to_their_caps(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 20), ("d", 500), (None, 3), ("e", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3]))
    left, open_, want = sum(s for _, s in sizes), set(weight), {}
    size = dict(sizes)
    while True:
        share = {k: left * weight[k] / sum(weight[o] for o in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * size[k]}
        if not over:
            break
        for k in over:
            want[k] = 3.0 * size[k]
            left -= want[k]
        open_ -= over
    assert got == pytest.approx({**want, **share})


def test_scan_keeps_everything_near():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    exact = q @ x.T
    least = np.sort(exact, axis=1)[:, -10]
    who, what = ann.scan(x, q, least)
    kept = set(zip(who.tolist(), what.tolist()))
    near = {(i, j) for i in range(20) for j in range(500) if exact[i, j] >= least[i]}
    assert len(kept & near) >= 0.95 * len(near)
    assert len(kept) < 0.2 * exact.size


def test_rare_telling_terms_are_chosen():
    """Behind many stronger terms, a word of 30 in 2,500 toxic examples tells them apart by 5.5 standard errors."""
    texts = [" ".join(f"w{chr(97 + j % 26)}{j // 26}" for j in range(i % 100)) for i in range(2_500)]
    texts = [f"{t} {'rare' if i < 30 else ''}".encode() for i, t in enumerate(texts)] + [b"plain"] * 2_500
    terms = toxicity.choose_terms(texts, np.repeat([1, 0], 2_500))
    assert terms.index("rare") >= toxicity.FEW


def test_nearest_examples_are_exact():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(1, 12))).encode() for _ in range(300)]
    labels = np.array([rng.randint(0, 1) for _ in texts])
    vocabulary = {c * 2: i for i, c in enumerate("abcdefghij")}
    index = toxicity.build_index(list(range(300)), texts, labels, vocabulary, np.linspace(1, 2, 10), 0.3)
    rows = toxicity.TermRows(vocabulary)
    for text in texts[:60]:
        counts = rows.counts(text)
        terms, weights = index.weigh(counts)
        scores = np.zeros(300)
        for t, w in zip(terms, weights):
            part = slice(index.starts[t, 0], index.starts[t, -1])
            scores[index.where[part]] += w * index.weights[part]
        order = np.lexsort((np.arange(300), -np.round(scores, toxicity.DIGITS)))[:15]
        assert [i for _, i in index.nearest(counts, 15)] == [i for i in order.tolist() if scores[i] > 0]


def test_lists_of_skewed_vectors(spark, monkeypatch):
    """20,000 vectors, a third copies, small groups far out: k rows for every query, recall against brute force.

    The sample is a tenth of the table, as it is of 200,000 vectors.
    """
    monkeypatch.setattr(ann, "SAMPLE", 2_000)
    rng = np.random.default_rng(9)
    x = 10 * np.linalg.qr(rng.normal(size=(64, 64)))[0][rng.integers(0, 40, 20_000)] + 0.2 * rng.normal(size=(20_000, 64))
    x[rng.permutation(20_000)[:6_666]] = x[rng.integers(0, 5, 6_666)]
    out = rng.permutation(20_000)[:500]
    far = rng.normal(size=(100, 64))
    x[out] = np.repeat(20 * far / np.linalg.norm(far, axis=1)[:, None], 5, axis=0) + 0.2 * rng.normal(size=(500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.repartition(4)
    even, outer = set(range(0, 20_000, 20)), set(out.tolist())
    found = {q: {} for q in even | outer}
    for r in ann.nearest(df, df.where(F.col("vec_id").isin([*found])), k=20).collect():
        found[r.query_id][r.rank] = r.vec_id
    recall = {}
    for q in found:
        scores = x @ x[q]
        scores[q] = -np.inf
        # copies are as good as each other
        recall[q] = (scores[list(found[q].values())] >= np.sort(scores)[-20] - 1e-9).sum() / 20
    print(*(f"recall {np.mean([recall[q] for q in some]):.4f}" for some in (even, outer)))
    assert all(sorted(f) == list(range(1, 21)) for f in found.values())
    assert np.mean([recall[q] for q in even]) >= 0.95
    assert np.mean([recall[q] for q in outer]) >= 0.6


def test_small_tables_are_pruned_by_trial():
    rng = np.random.default_rng(3)
    x = np.repeat(10 * rng.normal(size=(10, 16)), 50, axis=0) + rng.normal(size=(500, 16))
    x[:170] = x[0]
    index = ann.train_index([Row(vec_id=i, v=v.tolist()) for i, v in enumerate(x)], len(x), 20)
    assert index.probes < len(index.centres)
    assert (np.bincount(index.own, minlength=len(index.centres)) > 0).all()


def test_words_that_their_first_bytes_rule_out_have_no_terms():
    rng = random.Random(3)
    letters = ["a", "b", "é", "-", "'", "ab", "abc", "."]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))).encode() for _ in range(3000)] + [b"\xff\xfeabab", b"", b"abab\xff"]
    terms = sorted({t for w in words for t in toxicity.terms_of(w)})
    vocabulary = {t: i for i, t in enumerate(rng.sample(terms, 60))}
    rows = toxicity.TermRows(vocabulary)
    for word in words:
        wanted = sorted(vocabulary[t] for t in toxicity.terms_of(word) if t in vocabulary)
        assert sorted(rows.rows[rows[word]]) == wanted
    assert any(rows.values())
    # a plain word costs no look-up of its terms
    rows = toxicity.TermRows({"insult": 0, "insu-": 1})
    assert [rows[w] for w in (b"river", b"(insurance)", b"insult!")] == [0, 1, 2] and len(rows.rows) == 3
    rows.vocabulary = None
    assert rows[b"mountain"] == 0
