import math

import numpy as np
import pytest

from autolot.llm import whitening as W


def spectrum(rng, values):
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("d", [1, 2, 7, 40, 130])
def test_components_of_odd_spectra(d):
    rng = np.random.default_rng(d)
    some = rng.standard_normal((3 * d, max(1, d // 3))) @ rng.standard_normal((max(1, d // 3), d))
    for v in (spectrum(rng, rng.uniform(0, 1, d)), spectrum(rng, np.ones(d)), spectrum(rng, [1.0] * (d // 2) + [0.5] * (d - d // 2)), spectrum(rng, np.logspace(0, -8, d)), some.T @ some, np.eye(d) * 1e9, np.diag(np.arange(d) / 8.0 + 1)):
        v = (v + v.T) / 2
        values, vectors = W.leading(v, 8)
        want = np.linalg.eigvalsh(v)[::-1]
        k = len(values)
        assert k == min(8, int((want > want[0] * d * 2e-15).sum()))
        np.testing.assert_allclose(values, want[:k], rtol=1e-9, atol=1e-14 * want[0])
        assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * want[0] * d
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def test_inertia_counts():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 30):
        a = rng.standard_normal((d, d))
        for v in (a + a.T, np.diag(np.arange(d) - d / 2 + 0.25), np.fliplr(np.eye(d)), np.zeros((d, d))):
            e = np.linalg.eigvalsh(v)
            for s in (-0.31, 0.17, e[0] + 0.01):
                assert W.above(v, s) == int((e > s).sum())


def test_all_of_many_equal_eigenvalues_are_found():
    """Inertia says how many lie in an interval; none may be missing, though they can't be told apart."""
    v = spectrum(np.random.default_rng(4), [1.0] * 20 + [0.3] * 30)
    values, vectors = W.leading(v, 8)
    assert np.abs(values - 1).max() < 1e-13 and vectors.shape == (50, 8)
    assert sum(n for _, _, n in W.intervals(v / np.abs(v).sum(1).max(), 8)) == 20


def brute(rows, scale=1024, shift=100_000, k=8):
    good = [(i, [math.floor(scale * float(c)) + shift for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, x = len(good), np.array([v for _, v in good], object)
    sums = x.sum(0)
    y = np.array([[float((n * c - s)) / n for c, s in zip(v, sums, strict=True)] for v in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return good, n, dev, y @ u / np.sqrt(e), e / np.trace(v)


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 12)) * np.linspace(2, 0.2, 12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    odd = [(None, rows[0][1]), (7, rows[7][1]), (900, None), (901, [None] * 12), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, []), (905, [1.0] * 3), (906, [1e300] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2.0, "z") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, whitened double, component string").repartition(5)
    got = W.whiten(df).collect()
    good, n, dev, white, explained = brute(rows + odd[:2])
    assert len(got) == 8 * n == 8 * 302 and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(1, 9):
        mine = np.array([by[i, c][0].whitened for i, _ in good])
        sign = np.sign(mine @ white[:, c - 1])
        np.testing.assert_allclose(mine * sign, white[:, c - 1], atol=1e-9)
        assert abs(by[0, c][0].explained - explained[c - 1]) < 1e-12
    assert all(by[i, 1][0].deviation == d for (i, _), d in zip(good, dev, strict=True))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(i) * 100, 1.0 * (i % 3)]) for i in range(4000)]
    got = {r.vec_id: r.deviation for r in W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    dev = brute(rows, k=2)[2]
    assert any(d >= 2**63 for d in dev) and any(d < 2**63 for d in dev)
    assert [got[i] for i in range(4000)] == [d if d < 2**63 else None for d in dev]


def test_few_and_none(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert W.whiten(make(rows)).count() == 0
    got = W.whiten(make([(1, [1.0, 2.0]), (2, [3.0, 5.0])])).collect()  # one component: two rows lie on a line
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), round(r.explained, 12)) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_the_query_on_the_given_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    good, n, dev, white, explained = brute(rows)
    got = W.query(spark, sf_dir).toPandas()
    assert len(got) == 8 * n and got["identity_error"].max() < 1e-10
    for c in range(1, 9):
        mine = got[got["component"] == c].set_index("vec_id").loc[[i for i, _ in good]]
        assert mine["deviation"].tolist() == dev and abs(mine["explained"].iloc[0] / explained[c - 1] - 1) < 1e-10
        sign = np.sign(mine["whitened"].to_numpy() @ white[:, c - 1])
        np.testing.assert_allclose(mine["whitened"] * sign, white[:, c - 1], atol=1e-8)
