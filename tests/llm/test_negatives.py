import math
import random

import pytest
from pyspark.sql import functions as F

from autolot.llm import negatives as N


def usable(rows, scale=256):
    out = [(i, g, [math.floor(scale * x) for x in v]) for i, g, v in rows if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = [r for r in out if sum(x * x for x in r[2]) <= 9e18]
    sizes = [len(r[2]) for r in out]
    return [r for r in out if len(r[2]) == max(set(sizes), key=lambda n: (sizes.count(n), n))]


def brute(rows, every, positives, top, low, high):
    good, out = usable(rows), []
    for a, g, u in good:
        if a % every:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(u, v, strict=True)), i, h == g) for i, h, v in good if i != a), key=lambda r: r[:2])
        for p, pid, _ in [s for s in scores if s[2]][:positives]:
            found = [(i, -s) for s, i, same in scores if not same and low * -p <= 100 * -s <= high * -p][:top]
            out += [(a, pid, n + 1, i, -p, s) for n, (i, s) in enumerate(found)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df, **kwargs):
    return sorted(tuple(r) for r in N.mine(df, **kwargs).select(*COLUMNS).collect())


@pytest.mark.parametrize("sizes", [{}, {"group": 3, "block": 50}])
def test_equal_to_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.gauss(0, 0.3) + 0.4 for _ in range(5)]) for i in range(400)]
    rows += [(i, 1, rows[20][2]) for i in range(400, 460)]  # equal rows of another label: ties
    rows += [(None, 1, [1.0] * 5), (500, None, [1.0] * 5), (520, 1, None), (540, 1, [1.0, None, 1.0, 1.0, 1.0]), (560, 1, [math.nan] * 5), (580, 1, [math.inf] * 5), (600, 1, [1.0] * 4), (620, 2, [1e12] * 5), (640, 2, [1e300] * 5), (660, 0, [])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, label int, embedding array<double>, b int, anchor string")
    want = brute(rows, 20, 5, 10, 30, 90)
    assert len(want) > 500 and mined(df, every=20, **sizes) == want


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.uniform(0, 4e6) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute(rows, 10, 5, 10, 30, 90)
    assert max(r[4] for r in want) > 2**53 and mined(df, every=10) == want


def test_few_and_none(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert mined(spark.createDataFrame([], schema)) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], schema)) == []  # no anchor
    assert mined(spark.createDataFrame([(0, 1, [1.0]), (2, 2, [0.5])], schema)) == []  # no positive
    assert mined(spark.createDataFrame([(0, 1, [1.0]), (2, 1, [-1.0]), (3, 2, [-0.5])], schema)) == []  # a positive below zero
    assert mined(spark.createDataFrame([(0, 1, [1.0]), (2, 1, [1.0]), (3, 2, [0.5]), (5, 2, [0.9]), (6, 3, [0.95])], schema)) == [(0, 2, 1, 5, 65536, 58880), (0, 2, 2, 3, 65536, 32768)]


def test_one_label_holds_most_rows(spark):
    """A hot label's rows are cut into blocks; the result does not depend on how."""
    rng = random.Random(6)
    rows = [(i, 0 if i % 10 else 1, [rng.gauss(0.3, 0.3) for _ in range(3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df, block=40, group=2) == mined(df.repartition(5)) == brute(rows, 100, 5, 10, 30, 90)


def test_the_query_shifts_labels(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in table.collect()]
    assert sorted(tuple(r) for r in N.query(spark, sf_dir).select(*COLUMNS).collect()) == brute(rows, 100, 5, 10, 30, 90)


def test_limits_of_windows(spark):
    p = [-(2**62), -101, -100, -99, -1, 0, 1, 99, 100, 101, 12345, 2**62 - 7]
    got = spark.createDataFrame([(x,) for x in p], "p long").select("p", N.portion(F.col("p"), 30, F.ceil).alias("low"), N.portion(F.col("p"), 90, F.floor).alias("high")).collect()
    assert [tuple(r) for r in got] == [(x, -(-30 * x // 100), 90 * x // 100) for x in p]
