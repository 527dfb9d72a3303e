import hashlib
import math
from collections import Counter

from autolot.llm import mixing as M
from autolot.llm.common import table
from tests.llm import samples


def draw(rate, doc_id, seed=M.SEED):
    parts = max(1, math.ceil(rate / M.STEP))
    n = 0
    for j in range(1, parts + 1):
        key = f"{seed}:{'null' if doc_id is None else doc_id}:{j}"
        u, lam, k = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52, rate / parts, 0
        p = cdf = math.exp(-lam)
        while cdf <= u and k < math.ceil(lam + 12 * math.sqrt(lam) + 20):
            k += 1
            p = p * lam / k
            cdf += p
        n += k
    return n


def test_copies_follow_the_draws(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = {"src0": 6.0, "src1": 0.5, "src2": 300.0}
    rows = {r.doc_id: r.source for r in docs.collect()}
    n = Counter(rows.values())
    got = Counter(r.doc_id for r in M.mix(docs, weights).select("doc_id").collect())
    for i, s in rows.items():
        rate = weights.get(s, 0.0) / sum(weights.values()) * len(rows) / n[s]
        assert got[i] == (draw(rate, i) if rate else 0)


def test_means_are_met(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', cast(id % 5 as string)) AS source")
    got = {r.source: r["count"] for r in M.mix(docs, power=1.0).groupBy("source").count().collect()}
    assert abs(got["hot"] / (20_000 / 3) - 1) < 0.05
    even = {r.source: r["count"] for r in M.mix(docs, {str(k): 1.0 for k in range(5)} | {"hot": 5.0}).groupBy("source").count().collect()}
    assert abs(even["hot"] / 10_000 - 1) < 0.05


def test_odd_rows(spark):
    docs = samples.documents(spark)
    out = M.mix(docs, power=0.0)
    assert out.columns == docs.columns + ["mix_copy", "rate", "position"]
    own = docs.withColumn("copy", M.F.lit(77))
    assert {r.copy for r in M.mix(own, power=0.0).collect()} == {77}
    assert {r.source for r in out.collect()} <= {"a", "b", None}
    assert M.mix(docs, {"a": 1.0}).where("source is null or source <> 'a'").count() == 0
    assert M.mix(docs, {None: 1.0}).where("source is not null").count() == 0
    assert M.mix(samples.empty(spark)).count() == 0


def test_small_weights_count(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id < 1000, 'a', 'b') AS source")
    got = {r.source: r for r in M.rates(docs, {"a": 3e-12, "b": 1e-12}).collect()}
    assert abs(got["a"].weight - 0.75) < 1e-9 and abs(got["b"].rate - 0.25 * 3000 / 2000) < 1e-9
    assert M.rates(docs, {"c": 1.0}).where("rate <> 0").count() == 0 and M.mix(docs, {"c": 1.0}).count() == 0
