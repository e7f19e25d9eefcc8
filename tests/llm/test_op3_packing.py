import itertools
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scatterspark.llm import op3_packing as op


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(hist, buckets):
    edges = np.array(sorted(hist))
    counts = np.array([hist[e] for e in edges])

    def cost(bounds):
        return sum((min(b for b in bounds if b >= e) - e) * c for e, c in zip(edges, counts))

    got = op.choose_boundaries(edges, counts, buckets)
    assert got == sorted(set(got)) and got[-1] == edges[-1] and len(got) <= buckets
    brute = min(cost([*x, edges[-1]]) for k in range(buckets) for x in itertools.combinations(edges[:-1], k))
    assert cost(got) == brute


def test_boundaries_between_bins_of_several_lengths(spark):
    """The least padding of all choices of bins, and buckets that reach no further than their longest text."""
    lengths = [300, 301, 301, 302, 900, 905, 905, 2000, 2011, 7000, 7]
    rows = [(i, n) for i, n in enumerate(lengths)]
    got = op.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 3, 9000).collect()
    bounds = sorted({r.bucket for r in got})
    assert all(b in lengths for b in bounds) and bounds[-1] == 7000
    tops = [7, 302, 905, 2011]
    cost = lambda bs: sum(min(b for b in bs if b >= n) - n for n in lengths)
    assert cost(bounds) == min(cost([*x, 7000]) for x in itertools.combinations(tops, 2))


def test_bins_are_upper_edges(spark):
    rows = [(n,) for n in [0, 1, 255, 256, 257, 258, 511, 512, 513, 514, 1023, 1024, 1025, 1030, 99_999]]
    for n, e in spark.createDataFrame(rows, "n long").select("n", op.bin_edge(op.F.col("n"))).collect():
        assert e >= n and (e == n if n <= 256 else e - n < n / 64)


def test_batches_are_gapless_and_within_budget(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(n)) for i, n in enumerate(rng.zipf(1.4, 3000).clip(0, 30_000))] + [(5, 17), (None, 3), (None, 3)]
    got = op.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 6, 2048).collect()
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got) == sorted((a is None, a or 0, b) for a, b in rows)
    by = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket
        by[r.bucket].append((r.batch, r.slot))
    assert len(by) <= 6
    for bucket, x in by.items():
        per = max(1, 2048 // bucket)
        assert sorted(x) == [(i // per, i % per) for i in range(len(x))]


def test_words_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, " a  b\nc "), (5, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", op.F.lit("clash"))
    got = dict(df.select("doc_id", op.n_words(op.F.col("text"))).collect())
    assert got == {1: 0, 2: 0, 3: 0, 4: 3, 5: 50_000}
    packed = op.pack(df.select("doc_id", op.n_words(op.F.col("text")).alias("n_tokens"), "bucket"), 3, 100)
    assert packed.count() == 5
    assert op.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
