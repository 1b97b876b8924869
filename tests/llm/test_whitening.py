import math

import numpy as np
import pytest

from gradpath.llm import whitening
from gradpath.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, wanted=16):
    """(rows, eigenvalues, vectors, deviations) by forming the covariance."""
    ok = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in ok], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = (n * fit - sums) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    deviation = [sum(int(c) ** 2 for c in n * r - sums) for r in x]
    return [i for i, _ in ok], n, e, (z.T @ z / n).trace(), ((n * x - sums) / n) @ u / np.sqrt(e), deviation


def some(n=400, d=24, seed=5):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) @ (np.diag(np.linspace(2, 0.2, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0])).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [None] + [0.5] * (d - 1)), (n + 2, [float("nan")] * d), (n + 3, [float("-inf")] * d), (n + 4, []), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1])]
    return rows


def table(spark, path, rows, extra=""):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    (df.selectExpr("*", extra) if extra else df).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_query_against_the_formed_covariance(spark, tmp_path):
    rows = some()
    got = QUERIES["op11_whitening"](spark, table(spark, tmp_path, rows, "1.5D as x")).toPandas()
    ids, n, e, trace, want, deviation = brute(rows)
    assert len(got) == len(ids) * 16 and set(got["component"]) == set(range(1, 17)) and set(got["n"]) == {n}
    key = lambda i: -1 if i is None or i != i else int(i)
    for k in range(1, 17):
        mine = got[got.component == k]
        a = sorted((key(i), dv, w) for i, dv, w in zip(mine.vec_id, mine.deviation, mine.whitened))
        for flip in (1, -1):
            b = sorted((key(i), dv, flip * w) for i, dv, w in zip(ids, deviation, want[:, k - 1]))
            if [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-9):
                break
        else:
            raise AssertionError(k)
        assert np.allclose(mine.explained, e[k - 1] / trace, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


@pytest.mark.parametrize("rows,components,n", [
    ([], 0, 0),
    ([(1, None), (2, [])], 0, 0),
    ([(1, [0.5, 0.5]), (2, [0.5, 0.5])], 0, 0),
    ([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])], 1, 3),
    ([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0, 3.0])], 2, 3),
])
def test_small_tables(spark, rows, components, n):
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert len(got) == components * n and {r["component"] for r in got} == set(range(1, components + 1))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 5)], 1) for i in range(9)], SCHEMA)
    df = df.selectExpr("*", "1 as id", "2 as v", "3 as x", "4 as component", "5 as n")
    assert whitening.whitened(df).count() == 18


def test_solver():
    rng = np.random.default_rng(1)
    for d, wanted in ((1, 16), (5, 16), (120, 16), (200, 6)):
        a = rng.standard_normal((400, d)) * np.linspace(4, 0.5, d)
        v = a.T @ a / 400
        e, u = whitening.leading(lambda b: v @ b, d, wanted)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][: len(e)], rtol=1e-12) and len(e) == min(d, wanted)
        assert np.abs(v @ u - u * e).max() < 1e-12 * e[0] and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12


def test_solver_with_ties_and_zeros():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    e = np.array([5.0] * 7 + [2.0] * 20 + [0.0] * 63)
    v = q @ np.diag(e) @ q.T
    got, u = whitening.leading(lambda b: v @ b, 90, 30)
    assert np.allclose(got, e[:30], atol=1e-12) and np.abs(v @ u - u * got).max() < 1e-12


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    v, q = a @ a.T, np.linalg.qr(rng.standard_normal((30, 3)))[0]
    b = rng.standard_normal((30, 2))
    b -= q @ (q.T @ b)
    theta = np.array([1.5, 20.0])
    t = whitening._minres(lambda y: v @ y, theta, q, b, 60)
    p = np.eye(30) - q @ q.T
    for k in range(2):
        assert np.allclose(p @ (v - theta[k] * np.eye(30)) @ p @ t[:, k], b[:, k], atol=1e-6)


def test_a_deviation_beyond_a_bigint_is_an_error(spark):
    rows = spark.createDataFrame([(i, [i * 1e8, 1.0], 0) for i in range(9)], SCHEMA)
    with pytest.raises(Exception, match="larger than a bigint"):
        whitening.whitened(rows).collect()
