import numpy as np
import pytest

from scatterspark.functions.kernels import CovarianceKernel, bessel_k
from scatterspark.operators.hmatrix import aca, truncated_svd
from scatterspark.operators.sparse import semismooth_newton
from scatterspark.sources import matrices


def test_ascii_round_trip_and_ragged_rows(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.5],), ([3.0, -1e-7],)], "v array<double>").coalesce(1)
    matrices.write_ascii(df, f"{tmp_path}/m")
    assert [r.v for r in matrices.read_ascii(spark, f"{tmp_path}/m").orderBy("row").collect()] == [[1.0, 2.5], [3.0, -1e-7]]
    (tmp_path / "bad.txt").write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        matrices.read_ascii(spark, f"{tmp_path}/bad.txt")


def test_binary_both_orders(spark, tmp_path):
    m = np.arange(6.0).reshape(2, 3)
    (tmp_path / "a.bin").write_bytes(matrices.binary_matrix(m))
    raw = bytearray(matrices.binary_matrix(m.T))
    raw[8:16], raw[16:24], raw[24:32] = (0).to_bytes(8, "little"), (2).to_bytes(8, "little"), (3).to_bytes(8, "little")
    (tmp_path / "b.bin").write_bytes(bytes(raw))
    for name in ("a.bin", "b.bin"):
        assert [r.v for r in matrices.read_binary(spark, f"{tmp_path}/{name}").orderBy("row").collect()] == m.tolist()


def test_sparse_text_matlab_and_vtk(spark, tmp_path):
    matrices.write_sparse_ascii(spark.createDataFrame([(0, 1, 2.5)], "i long, j long, v double"), f"{tmp_path}/s")
    assert spark.read.text(f"{tmp_path}/s").first()[0] == "1 2 2.5"
    assert "rows_a = [1];" in "".join(matrices.matlab_lines("a", [(0, 1, 2.5)]))
    points, cells = matrices.box_cells([([0.0, 0.0], [1.0, 2.0])])
    text = "".join(matrices.vtk_lines(points, cells, cell_data=[3.0]))
    assert "POINTS 4 float" in text and "CELL_TYPES 1\n9" in text and "CELL_DATA 1" in text


def test_kernels_agree_and_unknown_names_fail(spark):
    r = np.array([0.0, 1e-3, 0.3, 1.0, 4.0])
    for nu, name in ((1.5, "MATERN32"), (2.5, "MATERN52")):
        s = np.sqrt(2 * nu) * r[1:]
        k = 2 ** (1 - nu) / np.exp(np.log(np.prod([x for x in np.arange(nu - 1, 0, -1)]) * (np.pi**0.5))) * s**nu * bessel_k(nu, s)
        assert np.allclose(k, CovarianceKernel(name).values(r)[1:], atol=1e-8)
    general = CovarianceKernel("maternnu", nu=1.3).values(r)
    assert np.all(np.diff(general) < 0) and general[0] == 1
    df = spark.createDataFrame([(float(x),) for x in r], "r double")
    got = [v[0] for v in df.select(CovarianceKernel("MaternNu", nu=1.3).of(df["r"])).collect()]
    assert np.allclose(got, general)
    with pytest.raises(ValueError):
        CovarianceKernel("nope")
    with pytest.raises(ValueError):
        CovarianceKernel("gaussian", metric="nope")


def test_low_rank_blocks():
    rng = np.random.default_rng(0)
    a = np.exp(-np.abs(rng.random((60, 1)) - 3 - rng.random((1, 50))))
    left, right = aca(lambda i: a[i], lambda j: a[:, j], 60, 50, 1e-10)
    assert np.abs(left @ right.T - a).max() < 1e-8 and left.shape[1] < 5
    left, right = truncated_svd(a, 1e-8)
    assert np.linalg.norm(left @ right.T - a) <= 1e-7 * np.linalg.norm(a)


def test_l1_solution_is_optimal():
    rng = np.random.default_rng(1)
    m, y, w = rng.normal(size=(30, 20)), rng.normal(size=30) * 3, np.full(20, 2.0)
    z = semismooth_newton(m, y, w, 2000)
    g = m.T @ (m @ z - y)
    assert np.all(np.abs(g[z == 0]) <= w[z == 0] + 1e-6) and np.abs(g[z != 0] + w[z != 0] * np.sign(z[z != 0])).max() < 1e-6


def test_row_numbers_over_several_files(spark, tmp_path):
    from scatterspark.sources import matrices

    for k in range(3):
        (tmp_path / f"part-{k}").write_text("\n".join(f"{10 * k + i} 1.5" for i in range(4)) + "\n\n")
    got = matrices.read_ascii(spark, str(tmp_path)).collect()
    assert sorted(r.row for r in got) == list(range(12))
    by = {r.v[0]: r.row for r in got}
    assert all(by[10.0 * k + i + 1] == by[10.0 * k + i] + 1 for k in range(3) for i in range(3))
