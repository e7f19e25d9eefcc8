import os
import re
import time

import numpy as np
import pytest

from scatterspark.llm import op10_jaccard_join as op
from scatterspark.llm.shingles import shingle_sets


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                comp[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return {d: (len(s), best[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def family(rng, base, n, share):
    """Copies of a text, each with some words replaced."""
    out = []
    for _ in range(n):
        w = list(base)
        for i in np.flatnonzero(rng.random(len(w)) < share):
            w[i] = f"v{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \n ", "a b", "A\tB", "a b c", "a b c d e", "A b C d e", "x " * 30_000, "x " * 29_000 + "y", "é\x85ü b c d e f"]
    for k in range(6):
        base = [f"w{rng.integers(400)}x{k}" for _ in range(int(rng.integers(30, 250)))]
        texts += family(rng, base, 25, 0.005 * (k + 1)) + [" ".join(base)] * 3
    for _ in range(60):
        own = [f"o{rng.integers(10**6)}" for _ in range(int(rng.integers(5, 60)))]
        texts.append(" ".join(own + passage))
    order = rng.permutation(len(texts))
    return [(int(i) * 3 + 1, texts[i]) for i in order]


def test_components_against_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L as rep", "2L as n", "'c' as h").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.join_components(df).collect()}
    want = plain_components(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 100


def test_null_and_repeated_ids_and_empty_table(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in op.join_components(df).collect() if r.component_id)
    assert got == [(2, 2, 2), (4, 2, 2), (4, 2, 2)]
    assert op.join_components(df).count() == 5
    assert op.join_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_different_texts_under_one_id(spark, order):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    df = spark.createDataFrame([(7, a), (7, b), (9, b + " more"), (11, a + " more"), (8, "c " + b)][::order], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in op.join_components(df).collect())
    assert got == [(7, 7), (7, 7), (8, 7), (9, 7), (11, 7)]


def test_hashes_do_not_depend_on_the_batch():
    t = ["b C d e f g", "zz yy", "", None, "q " * 100]
    alone = [shingle_sets([x])[0].tolist() for x in t]
    assert [s.tolist() for s in shingle_sets(t)] == alone
    assert [len(s) for s in alone] == [2, 1, 0, 0, 1]


def test_disk_is_given_back(spark, rows, monkeypatch):
    """Neither the shuffle files of steps that are done nor the prefixes stay until the result is read."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    made, real = [], op.saved
    monkeypatch.setattr(op, "saved", lambda x: (made.append(real(x)), made[-1])[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = files()
    out = op.join_components(df)
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
    held = [x for x in made if "prefix" in x.columns]
    assert held and not any(os.path.exists(f.removeprefix("file:")) for x in held for f in x.inputFiles())
    assert out.count() == len(rows)
