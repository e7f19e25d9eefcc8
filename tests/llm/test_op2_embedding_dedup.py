import numpy as np
import pytest

from scatterspark.llm import op2_embedding_dedup as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.93):
    n = len(rows)
    links, up = [0] * n, list(range(n))
    v = [np.array([np.nan if c is None else c for c in (e or [])], np.float32).astype(float) for _, e, _ in rows]
    ok = [len(x) > 0 and np.isfinite(x).all() and np.linalg.norm(x) > 0 and r[2] is not None for x, r in zip(v, rows)]

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]):
                if v[i] @ v[j] / np.sqrt(v[i] @ v[i]) / np.sqrt(v[j] @ v[j]) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[top(i)] = top(j)
    small = {}
    for i in range(n):
        small[top(i)] = min(small.get(top(i), rows[i][0]), rows[i][0])
    return {r[0]: (links[i], small[top(i)], r[0] == small[top(i)]) for i, r in enumerate(rows)}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for label in (0, 1, 2):
        for _ in range(60):
            c = rng.normal(size=24)
            for _ in range(rng.integers(1, 9)):
                x = c + rng.normal(size=24) * rng.choice([0, 0.1, 0.25, 0.35])
                out.append((list(map(float, x.astype(np.float32))), label))
    x = out[0][0]
    nan, inf = float("nan"), float("inf")
    out += [(None, 1), ([], 1), ([0.0] * 24, 1), ([None, *x[1:]], 0), ([nan, *x[1:]], 0), ([inf, *x[1:]], 0), (x[:12], 0), (x[:12], 0), (x, None), (x, None), ([2 * c for c in x], 0)]
    ids = rng.permutation(len(out) * 2)[: len(out)]
    return [(int(i), e, k) for i, (e, k) in zip(ids, out)]


@pytest.mark.parametrize("bucket, block", [(256, 2048), (16, 2048), (16, 5)])
def test_against_all_pairs(spark, rows, monkeypatch, bucket, block):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op.bands, "__defaults__", (op.RECALL, bucket))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L as rep", "'x' as band").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.near_duplicates(df).collect()}
    assert got == plain(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(size=(200, 64)) * 0.4
    x /= np.linalg.norm(x, axis=1)[:, None]
    est, err = op.estimates(op.encode(x[:200]), op.encode(x[200:]))
    z = (est - x[:200] @ x[200:].T) / err
    assert abs(z.mean()) < 0.05 and 0.7 < z.std() < 1.3 and np.abs(z).max() < op.SIGMAS + 0.5


def test_bands_reach_the_recall():
    for n in (10, 1000, 10**5, 10**9):
        bits, count = op.bands(n, 0.93)
        p = (1 - np.arccos(0.93) / np.pi) ** bits
        assert bits == 0 or 1 - (1 - p) ** count >= op.RECALL
    assert op.bands(10**9, 0.93)[0] > op.bands(10**5, 0.93)[0] > 0


def test_repeated_and_null_ids_and_empty_table(spark):
    x = [1.0, 2.0]
    df = spark.createDataFrame([(3, x, 1), (3, x, 1), (None, x, 1)], SCHEMA)
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in op.near_duplicates(df).collect()))
    assert got == [(-1, 0, None, False), (3, 1, 3, True), (3, 1, 3, True)]
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_vectors_at_the_ends_of_the_range_and_under_one_id(spark):
    rows = [(1, [1e200, 1e200], 5), (2, [1e-200, 1e-200], 5), (3, [5e-324, 5e-324], 5), (4, [1.7e308, -1.7e308], 5), (7, [1.0, 3.0], 5), (7, [-1.0, 3.0], 5), (8, [1.1, 3.0], 5), (9, [-1.1, 3.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]


def test_stored_codes():
    x = np.random.default_rng(7).normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    _, signs, factors = op.encode(x)
    codes, f = op.stored(x)
    assert (op.signs_of(codes, 64) == signs).all() and (f == factors).all() and len(codes[0]) == op.CODE // 8
