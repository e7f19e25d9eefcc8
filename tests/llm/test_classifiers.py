"""op1, op5 and op6 on small made-up corpora: held-out accuracy, folds, odd rows."""

import zlib

import numpy as np
import pytest

from scatterspark.llm import op1_toxicity as op1
from scatterspark.llm import op5_quality as op5
from scatterspark.llm import op6_language as op6

SCHEMA = "doc_id long, text string, lang string, score string"
ODD = [(9001, None, "xx", "s"), (9002, "", "xx", "s"), (None, "alpha beta", None, "s"), (9003, "word " * 40_000, "xx", "s"), (9003, "word " * 40_000, "xx", "s"), (9004, "12 34 !?", "xx", "s")]


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    syll = {"xx": ["ka", "lo", "mi", "ter", "on"], "yy": ["zu", "sch", "ber", "ung", "ei"]}
    docs, tox, good = [], [], []
    for i in range(n):
        lang = "xx" if i % 3 else "yy"
        words = ["".join(rng.choice(syll[lang], rng.integers(1, 4))) for _ in range(rng.integers(60, 200))]
        tox.append(int(rng.random() < 0.3))
        if tox[-1]:
            words[rng.integers(len(words))] = f"{rng.choice(['grukk', 'snarb'])}{rng.choice(['ist', 'el', 'um'])}"
        good.append(int(rng.random() < 0.7))
        if not good[-1]:
            at = rng.integers(1, len(words) - 20)
            words[at : at + 50] = [w.upper() + "$$%" for w in words[at : at + 50]]
        docs.append((i, " ".join(words), lang, "clash"))
    return docs, [(i, good[i], tox[i]) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    labels += [(5, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs + ODD, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), {i: (q, t) for i, q, t in labels[:-2]}


@pytest.mark.parametrize("op, k, cut", [(op1, 1, 0.5), (op5, 0, 0.3)])
def test_held_out_accuracy_and_odd_rows(tables, op, k, cut):
    docs, labels, truth = tables
    got = op.score(docs, op.fit(docs, labels)).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][k] for r in held]) > 0.93


@pytest.mark.parametrize("op", [op1, op5])
def test_without_labels(spark, tables, op):
    docs, labels, _ = tables
    assert {round(r.score, 6) for r in op.score(docs.limit(3), op.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert op.score(docs.limit(0), op.fit(docs.limit(0), labels)).count() == 0


def test_counterfactual_penalty_frees_identity_terms():
    rng = np.random.default_rng(1)
    texts, y = [], []
    for _ in range(600):
        toxic = rng.random() < 0.4
        who = "muslims" if rng.random() < (0.9 if toxic else 0.1) else rng.choice(["christians", "atheists"])
        texts.append(f"{who} {'vile' if toxic and rng.random() < 0.7 else 'calm'} {rng.choice(['went', 'came', 'sat'])} there")
        y.append(int(toxic))
    words = [op1.words_of(t) for t in texts]
    x = [np.array(sorted(op1.features(w))) for w in words]
    pairs = []
    for w, f in zip(words, x):
        for o in op1.counterfactuals(w):
            o = op1.features(o)
            pairs.append((np.array(sorted(set(f) - o)), np.array(sorted(o - set(f)))))
    free, tied = op1.train(x, np.array(y), []), op1.train(x, np.array(y), pairs)
    gap = lambda m: abs(np.subtract(*m.scores(["muslims calm went there", "christians calm went there"])))
    assert gap(free) > 0.3 and gap(tied) < 0.05
    assert tied.scores(["christians vile sat there"])[0] > 0.7


def test_attention_finds_the_bad_passage():
    docs, labels = corpus(300, 3)
    x, sizes = op5.encode([d[1] for d in docs])
    m = op5.train(x, sizes, np.array([q for _, q, _ in labels]))
    text = " ".join(["kalomi"] * 3 + [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ter", "on", "ka", "lo")] * 12)
    bad = " ".join(["KALO$$%", "TERON$$%", "MIKA$$%"] * 17)
    a, score = m.attention(*op5.encode([text + " " + bad]))
    assert score[0] < 0.3 and a[-2:].sum() > 1.5 * 2 / len(a)
    assert a.sum() == pytest.approx(1, abs=1e-5)


def test_presence_kernel():
    t = ["abc abd", "Abc-abd", "xyz", ""]
    k = lambda s: {s[i : i + n] for n in range(1, op6.MAX_N + 1) for i in range(len(s) - n + 1)}
    p = op6.presence(t)
    assert (p[0] == p[1]).all()  # case and marks do not count
    assert p[2].sum() == len(k(" xyz "))
    a, b = k(" abc abd "), k(" xyz ")
    x = op6.normalised(p)
    assert x[0] @ x[2] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)), abs=1e-6)


def test_language(tables):
    docs, _, _ = tables
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = op6.identify(docs, op6.fit(docs, per_language=60)).collect()
    assert len(got) == 406
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (9001, 9002, 9004):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id is not None and r.doc_id < 9000:
            assert r.lang_pred == truth[r.doc_id]
    none = op6.identify(docs.limit(2), op6.fit(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


@pytest.mark.parametrize("op", [op1, op5])
def test_scores_do_not_depend_on_the_layout(tables, op):
    docs, labels, _ = tables
    a, b = (op.score(docs, op.fit(docs.repartition(n, "text"), labels.repartition(n))).collect() for n in (1, 7))
    of = lambda rows: sorted((r.doc_id or -1, r.score) for r in rows)
    assert of(a) == of(b)


def test_labels_that_contradict(spark, tables):
    docs, labels, _ = tables
    both = labels.union(spark.createDataFrame([(1, 0, 0), (1, 1, 1)], labels.schema))
    for op in (op1, op5):
        assert op.score(docs, op.fit(docs, both)).count() == 406


def test_toxicity_minimises_its_objective():
    """The trained weights against a plain loop over the objective: no single weight can be moved to lower it much."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(200)]
    y = np.array([int(3 in r) if rng.random() < 0.8 else int(rng.random() < 0.5) for r in rows])
    pairs = [(np.array([3]), np.array([4])), (np.array([5]), np.array([6]))]
    m = op1.train(rows, y, pairs, weight=0.5, steps=600)
    kept = np.flatnonzero(m.weights)
    assert 3 in kept or 4 in kept

    def objective(w, b):
        total = 0.0
        for r, t in zip(rows, y):
            z = sum(w[i] for i in r) + b
            total += np.log1p(np.exp(-z if t else z)) / len(rows)
        for p, q in pairs:
            total += 0.5 / len(pairs) * (sum(w[i] for i in p) - sum(w[i] for i in q)) ** 2
        return total + 0.5e-4 * sum(w[i] ** 2 for i in range(12))

    w = m.weights[:12].astype(float)
    best = objective(w, m.bias)
    for i in kept:
        for step in (-0.02, 0.02):
            v = w.copy()
            v[i] += step
            assert objective(v, m.bias) > best - 2e-4
    assert objective(np.zeros(12), np.log(y.mean() / (1 - y.mean()))) > best


def test_attention_by_a_plain_loop():
    rng = np.random.default_rng(8)
    x, sizes = rng.normal(size=(9, op5.DIM)), np.array([1, 3, 5])
    shapes = ((op5.DIM, op5.HIDDEN), (op5.HIDDEN,), (op5.HIDDEN, op5.GATE), (op5.HIDDEN, op5.GATE), (op5.GATE,), (op5.HIDDEN,))
    w, b, v, u, g, c = (rng.normal(size=s) * 0.3 for s in shapes)
    m = op5.Model(np.zeros(op5.DIM), np.ones(op5.DIM), [w, b, v, u, g, c, 0.2])
    a, score = m.attention(x, sizes)
    at = 0
    for n, s in zip(sizes, score):
        h = [np.tanh(x[i] @ w + b) for i in range(at, at + n)]
        e = [np.exp(sum(g[k] * np.tanh(p @ v[:, k]) / (1 + np.exp(-(p @ u[:, k]))) for k in range(op5.GATE))) for p in h]
        z = sum(k / sum(e) * p for k, p in zip(e, h))
        assert a[at : at + n] == pytest.approx(np.array(e) / sum(e)) and s == pytest.approx(1 / (1 + np.exp(-(z @ c + 0.2))))
        at += n
