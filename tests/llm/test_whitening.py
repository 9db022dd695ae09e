"""Whitening against numpy's dense eigenvectors and Python's exact integers; the eigensolver on hard spectra."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import jacobidavidson, shared, whitening

SF = "/root/testdata/sf0.001"
#: Eigenvalues: apart, close, equal, of low rank, none, more than a space holds, one dimension, a cluster wider than a space.
SPECTRA = {
    "apart": 0.8 ** np.arange(40), "close": np.linspace(1, 2, 64), "equal": np.ones(64), "low": np.r_[np.arange(1.0, 6), np.zeros(59)], "none": np.zeros(7), "large": 1 / np.arange(1.0, 401),
    "one": np.array([3.0]), "cluster": np.r_[1 + 1e-9 * np.arange(50), np.linspace(0, 0.5, 150)],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenpairs_to_double_precision(name):
    e = SPECTRA[name]
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(e), len(e))))
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    got = jacobidavidson.largest(lambda u: v @ u, len(e), 32)
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:32]
    top = max(want[0], 1e-300)
    assert np.abs(got.values - want).max() <= 1e-13 * top
    assert (np.linalg.norm(v @ got.vectors - got.vectors * got.values, axis=0) <= 1e-13 * top * np.sqrt(len(e))).all()
    assert np.abs(got.vectors.T @ got.vectors - np.eye(len(want))).max() < 1e-13


def test_minres_solves_each_column():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    a, shift, b = a + a.T, np.array([0.5, -3.0, 40.0]), rng.standard_normal((30, 3))
    b[:, 1] = 0
    x = jacobidavidson.minres(lambda u: a @ u - u * shift, b, 60, 1e-12)
    assert np.abs(a @ x - x * shift - b).max() < 1e-8 and not x[:, 1].any()


def _plain(vectors):
    """x, n, S, whitened, explained of a dense calculation."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    return x, n, s, z, e[::-1], u[:, ::-1], np.trace(cov)


def _compare(rows, ids, vectors):
    x, n, s, z, e, u, trace = _plain(vectors)
    k = min(32, int((e > 1e-9 * e[0]).sum()))
    assert {r.component for r in rows} == set(range(1, k + 1))
    assert len(rows) == len(ids) * k
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    for t, i in enumerate(ids):
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[t], s))
        for c, r in got[i].items():
            assert (r.n, r.deviation) == (n, exact)
            assert abs(r.explained - e[c - 1] / trace) <= 1e-10
            assert r.identity_error < 1e-9
    w = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in ids])
    want = z @ u[:, :k] / np.sqrt(e[:k])
    gap = np.abs(np.diff(e[: k + 1])) / e[0] if k < len(e) else np.append(np.abs(np.diff(e)), 1) / e[0]
    for c in range(k):
        if min(gap[c], gap[c - 1] if c else 1) > 1e-6:
            assert np.abs(w[:, c] * np.sign(w[:, c] @ want[:, c]) - want[:, c]).max() < 1e-6


def test_op13_is_the_dense_calculation(spark):
    data = shared.table(spark, SF, "embeddings").toPandas()
    out = whitening.op13(spark, SF)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    _compare(out.collect(), data.vec_id.tolist(), data.embedding.tolist())


def _op13(spark, tmp_path, rows, ddl="vec_id long, embedding array<float>, whitened string, `_wh.ole` int"):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(*r, "x", 1) for r in rows], ddl).write.mode("overwrite").parquet(path)
    return whitening.op13(spark, str(tmp_path))


def test_op13_leaves_rows_out_and_keeps_the_rest(spark, tmp_path):
    rng = np.random.default_rng(2)
    good = [(k, [float(x) for x in rng.standard_normal(5).astype(np.float32) * 9]) for k in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (104, [])]
    _compare(_op13(spark, tmp_path, [*good, *bad]).collect(), [k for k, _ in good], [v for _, v in good])


def test_op13_few_rows(spark, tmp_path):
    assert _op13(spark, tmp_path, []).collect() == []
    assert _op13(spark, tmp_path, [(1, [1.0, 2.0])]).collect() == []  # no variance
    assert _op13(spark, tmp_path, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]).collect() == []
    two = _op13(spark, tmp_path, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0]), (None, [1.0, 2.0])]).collect()
    assert sorted((r.vec_id or 0, r.component, abs(r.whitened), r.explained, r.deviation) for r in two) == [(k, 1, 1.0, 1.0, 128**2) for k in (0, 1, 2, 2)]
    with pytest.raises(Exception, match="differ in length"):
        _op13(spark, tmp_path, [(1, [1.0, 2.0]), (2, [1.0])]).collect()


def test_deviations_are_exact_or_refused():
    y = np.array([[-40, 3], [7, 1 << 29]])
    sums = [12345, -678]
    assert whitening._deviations(y, 3, sums).to_pylist() == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in y]
    with pytest.raises(ValueError, match="fit a long"):
        whitening._deviations(y, 1 << 31, sums)


def test_large_means_lose_no_digits(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(-30, 30, (500, 6)) + 10**12
    df = spark.createDataFrame([(k, [float(c) / 64 for c in r], "o") for k, r in enumerate(y.tolist())], "vec_id long, v array<double>, other string")
    got = whitening.fit(whitening.blocks(df, "v"))
    x = np.array([[Fraction(int(c)) for c in r] for r in y])
    z = (x - x.sum(axis=0) / 500).astype(float)
    e = np.sort(np.linalg.eigvalsh(z.T @ z / 500))[::-1]
    assert np.abs(got.variances - e).max() < 1e-11 * e[0] and (got.residuals < 1e-12 * e[0]).all()
    out = whitening.transform(df, "v", got)
    assert out.columns == ["vec_id", "v", "other", "deviation", "whitened"]
    w = np.array([r[0] for r in out.orderBy("vec_id").select("whitened").collect()])
    assert np.abs(w.T @ w / 500 - np.eye(6)).max() < 1e-11
    assert out.filter(F.size("whitened") != 6).count() == 0
