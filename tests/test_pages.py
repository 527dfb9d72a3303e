"""Pages of a directory against a plain sort, and what they read."""

from __future__ import annotations

import random
import re
import tempfile

from pyspark.sql import functions as F

from autolot.operators import pages


def test_pages_equal_a_plain_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random()]), "x") for i in range(1000)]
    df, order = spark.createDataFrame(rows, "id int, note double, t string"), [F.desc_nulls_last("note"), F.col("id")]
    path = f"{tempfile.mkdtemp()}/p"
    pages.write(df, path, order, 90)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for skip, limit in ((0, 20), (85, 20), (500, 300), (990, 20), (1000, 20), (5000, 20), (0, 1000)):
        got = pages.page(spark, path, order, skip, limit)
        assert [r.id for r in got.collect()] == want[skip : skip + limit] and got.columns == df.columns
    assert pages.total(spark, path) == 1000


def test_a_deep_page_reads_one_range(spark):
    path, order = f"{tempfile.mkdtemp()}/p", [F.col("id").desc()]
    pages.write(spark.range(200_000), path, order, 10_000)
    found = pages.ranges(spark, path, 150_000, 20)
    page = pages.page(spark, path, order, 150_000, 20)
    assert len(found) <= 2 and [r.id for r in page.collect()] == list(range(49_999, 49_979, -1))
    scanned = spark.read.parquet(f"{path}/rows").where(F.col("_range").isin([r for r, _ in found])).count()
    assert scanned < 40_000 and re.search(r"PartitionFilters: \[[^\]]*_range#\d+ (=|IN)", page._jdf.queryExecution().toString())


def test_no_rows(spark):
    path = f"{tempfile.mkdtemp()}/p"
    pages.write(spark.createDataFrame([], "id int, note double"), path, [F.col("id")])
    got = pages.page(spark, path, [F.col("id")], 0, 10)
    assert got.count() == 0 and got.columns == ["id", "note"] and pages.total(spark, path) == 0
