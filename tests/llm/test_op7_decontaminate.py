import itertools
import re

import numpy as np

from scatterspark.llm import op7_decontaminate as op


def plain(docs, items):
    """Every item at every diagonal of every document."""
    w = lambda t: re.sub(r"\W+", " ", (t or "").lower()).split()
    out = {}
    for d, text in docs:
        a = w(text)
        for i, item in items:
            b = w(item)
            span = min(op.SPAN, len(b))
            may = 2 if len(b) >= 13 else 1 if len(b) >= 7 else 0
            hit = set()
            for g in range(-len(b) + 1, len(a)):
                if len(b) < op.SPAN and not 0 <= g <= len(a) - len(b):
                    continue
                eq = [0 <= g + k < len(a) and a[g + k] == x for k, x in enumerate(b)]
                for s in range(len(b) - span + 1):
                    if sum(eq[s : s + span]) >= span - may:
                        hit |= {k for k in range(s, s + span) if eq[k]}
            if hit:
                out[d, i] = (len(hit), len(b), min(hit), max(hit))
    return out


def test_masks_find_any_two_substitutions():
    for bad in itertools.combinations(range(op.SPAN), op.SPAN - op.EQUAL):
        assert any(not set(bad) & {o + m for m in mask} for mask in op.MASKS for o in range(op.SPAN - mask[-1]))


def test_masks_of_short_items():
    for n in range(1, op.SPAN):
        for bad in itertools.combinations(range(n), op.replaceable(n)):
            assert any(not set(bad) & set(m) for m in op.masks_of(n))


def test_against_every_diagonal(spark):
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.zipf(1.3, n).clip(0, 500)]
    items = [(i, " ".join(word(n))) for i, n in enumerate([2, 6, 7, 9, 12, 13, 14, 20, 40])] + [(20, None), (21, ""), (22, "a a a a a a a a a a a a a a a")]
    docs = [(100, None), (101, ""), (102, "A a, " * 40), (103, "b " * 30_000)]
    for k in range(150):
        item = items[k % 9][1].split()
        cut = item[int(rng.integers(0, max(1, len(item) // 3))) :] if k % 4 == 0 else item
        for i in range(len(cut)):
            if rng.random() < 0.1 * (k % 3):
                cut[i] = "zzz"
        docs.append((k, " ".join(word(rng.integers(0, 30))) + " " + ("; ".join(cut).upper() if k % 5 == 0 else " ".join(cut)) + "! " + " ".join(word(rng.integers(0, 30)))))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as doc_id")
    want = plain(docs[:-148] + docs[-148:], items)
    for most in (1_000_000, 30):
        got = {(r.doc_id, r.item_id): (r.n_equal, r.n_words, r["first"], r["last"]) for r in op.contaminated(d, b, most).collect()}
        assert got == want
    assert len(want) > 60


def test_odd_tables(spark):
    text = "one two three four five six"
    d = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(5, text), (None, text)], "item_id long, text string")
    assert op.contaminated(d, b).count() == 6
    assert op.contaminated(d, b.limit(0)).count() == op.contaminated(d.limit(0), b).count() == 0
