import math
import random

from autolot.llm import knn as K


def brute(rows, k, every, scale=64):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and v]
    good = [(i, v) for i, v in good if sum(x * x for x in v) <= 9e18]  # a larger one takes no part
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for j, v in good if j == q for i, x in good if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_equal_to_brute_force(spark):
    rng = random.Random(2)
    hub = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, hub if i % 3 == 0 else [rng.gauss(i % 4, 1) for _ in range(6)]) for i in range(900)]
    rows += [(None, hub), (20, None), (2000, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2020, [math.nan] * 6), (2040, [math.inf] * 6), (2060, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for kwargs in ({}, {"count": 7, "group": 5, "block": 40}):
        got = K.search(df, k=5, **kwargs)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 5, 20)


def test_large_numbers_are_exact(spark):
    rows = [(i, [1e7 + i, -1e7 + 2 * i, 3.0]) for i in range(0, 60)]
    got = K.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 3, 20)


def test_vectors_beyond_longs_take_no_part(spark):
    """A finite vector whose squares do not fit a long would make scores that are none; others beside it are exact."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-2e7, 2e7) for _ in range(4)]) for i in range(0, 90)]
    rows += [(100, [1e12] * 4), (101, [-1e300] * 4), (120, [1e17, 0.0, 0.0, 0.0]), (140, [4e7, 0.0, 0.0, 0.0]), (141, [-4.6e7, 0.0, 0.0, 0.0]), (160, [1e306] * 4)]
    got = {tuple(r) for r in K.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).select("query_id", "rank", "vec_id", "score").collect()}
    want = brute(rows, 4, 20)
    assert got == want and max(abs(r[3]) for r in want) > 2**60 and 140 in {r[0] for r in want} and not {100, 120, 160} & {r[0] for r in want}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.search(df).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 8192)]
    assert K.search(df.limit(0)).count() == 0
    assert K.search(spark.createDataFrame([(1, [2.0])], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_query_ids(spark):
    """More rows of a query's vec_id than k, far from all its neighbours."""
    rng = random.Random(4)
    rows = [(0, [100.0, 0.0])] * 12 + [(i, [rng.gauss(5, 0.1), rng.gauss(5, 0.1)]) for i in range(1, 60) if i % 20]
    rows += [(i, [rng.gauss(-50, 0.1), rng.gauss(-50, 0.1)]) for i in range(61, 99) if i % 20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = K.search(df, k=5).select("query_id", "rank", "vec_id", "score").collect()
    assert len(got) == 5 and {tuple(r) for r in got} == brute(rows, 5, 20)
    rows += [(20, [1.0, 2.0]), (20, [-3.0, 1.0]), (20, [0.0, 9.0])]  # a query of several vectors
    got = K.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).select("query_id", "rank", "vec_id", "score").collect()
    assert len(got) == 10 and {tuple(r) for r in got} == brute(rows, 5, 20)
    rows = [r for r in rows if r[0] != 20] + [(3, [100.0, 0.5])] * 9  # a candidate that is repeated, apart from its first cell
    got = K.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).select("query_id", "rank", "vec_id", "score").collect()
    assert len(got) == 5 and {tuple(r) for r in got} == brute(rows, 5, 20)


def test_vectors_of_other_lengths_take_no_part(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(100)]
    other = [(i, [rng.gauss(0, 1) for _ in range(2 + 4 * (i % 2))]) for i in range(100, 150)]
    extra = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows + other], "vec_id long, embedding array<double>, cell int, g int, row long")
    assert {tuple(r) for r in K.search(extra, k=5, block=10).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 5, 20)


def test_tables_of_the_driver_do_not_grow_with_rows(spark):
    """Many more rows or queries in the same cells make more blocks and shares, not more rows of the plan."""
    import numpy as np

    groups, need = [[0, 1], [2]], [[0, 1, 2], [1, 2]]
    seen = []
    for times in (1, 1000, 1_000_000):
        n, nq = np.array([5000, 3000, 9000]) * times, np.array([250, 150, 450]) * times
        sends, asks = (df.collect() for df in K.plan(spark, n, nq, groups, need, 4096, 4096))
        seen.append((len(sends), sum(len(r.groups) for r in sends), len(asks), sum(len(r.units) for r in asks)))
        assert {r.cell: r.blocks for r in sends} == {c: max(1, -(-int(n[c]) // 4096)) for c in range(3)}
    assert len(set(seen)) == 1 and seen[0][0] <= 3 and seen[0][1] <= 9 and seen[0][3] <= 9


def test_clusters_are_pruned(spark):
    import numpy as np

    rng = random.Random(9)
    rows = [(i, [20.0 * (c == i % 5) + rng.gauss(0, 0.2) for c in range(5)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in K.search(df, k=3, count=20, group=10, block=100).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 3, 20)
    centre = np.eye(5) * 1280
    need = K.needed(centre, np.full(5, 400), np.full(5, 30.0), [np.linspace(1, 5, 4)] * 5, [[c] for c in range(5)], np.full(5, 30.0), np.full(5, 1300.0), 3)
    assert need == [[c] for c in range(5)]
