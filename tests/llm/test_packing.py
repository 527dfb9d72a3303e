import zlib

import numpy as np
import pyarrow as pa

from autolot.llm import packing as P
from autolot.llm.common import materialize, table
from tests.llm import samples


def test_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    own, model = P.Tokenizer(P.vocabulary()), Tokenizer.from_file(P.vocabulary())
    texts = ["don't  dó it's\x1cx   y z", "<|endoftext|> a<|endoftext|>b <|x", "", "  ", "Ünḯ ΑΣ Σ ﬁ 中文字 12 3a's", "a\r\n\tb\u0085c", " ́a", "é'll x'LL", "ÀÉÑ×÷ ß Ünñ 12ab 3,4!! #x  é\n", "<x|", "\u0000", "a" * 5000, "É" * 300]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = rng.integers(1, 65, rng.integers(1, 200))
        window, offset = P.best_fit_decreasing(lengths, 64)
        free = []
        for n in sorted(lengths, reverse=True):
            fits = [(f, i) for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits)[1]] -= n
            else:
                free.append(64 - n)
        left = np.full(window.max() + 1, 64)
        np.subtract.at(left, window, lengths)
        assert sorted(left.tolist()) == sorted(free) and (offset + lengths <= 64).all()


def whole(docs, packed):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.vocabulary())
    rows = packed.orderBy("sequence_id", "offset").collect()
    at = {}
    for r in rows:
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= P.CAPACITY
    want = []
    for d in docs.collect():
        ids = np.array([*model.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d.doc_id, s, zlib.crc32(ids[s : s + P.CAPACITY].tobytes()), len(ids)) for s in range(0, len(ids), P.CAPACITY)]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in rows), key=lambda x: str(key(x))) == sorted(want, key=lambda x: str(key(x)))
    return sum(at.values()), len(at)


def test_round_trip_and_padding(spark, sf_dir):
    tokens, sequences = whole(table(spark, sf_dir, "documents"), P.query(spark, sf_dir))
    assert tokens / (sequences * P.CAPACITY) > 0.97


def test_ids_can_be_kept(spark, sf_dir):
    rows = P.pieces(table(spark, sf_dir, "documents").limit(5), P.vocabulary(), keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_odd_rows(spark):
    docs = samples.documents(spark)
    whole(docs, P.pack_documents(docs))
    assert P.pack_documents(samples.empty(spark)).count() == 0


def test_many_equal_rows_go_to_many_bins(spark):
    """Short and window-long pieces of one document, repeated very often: no bin gets much more than its share."""
    short, full = ("a", 0, 300, 7, 300), ("b", 0, P.CAPACITY, 9, P.CAPACITY)
    rows = spark.createDataFrame([short, full], f"doc_id string, {P.PIECE}")
    found = materialize(rows.join(spark.range(100_000)), "equal")
    packed = P.pack(found, bin_tokens=1 << 20).select("length", "sequence_id", "offset", (P.F.col("sequence_id") / 2 % (30_000_000 // (1 << 20) + 1)).cast("int").alias("bin"))
    rows = packed.toPandas()
    assert len(rows) == 200_000
    part = rows[rows["length"] == 300]
    assert part.groupby("bin")["length"].sum().max() < 2 * (1 << 20) and part["bin"].nunique() > 25
    assert part.groupby("sequence_id")["length"].sum().max() <= P.CAPACITY and part["sequence_id"].nunique() < 1.02 * 100_000 / 6
    assert rows[rows["length"] == P.CAPACITY]["sequence_id"].nunique() == 100_000
    plan = P.pack(found)._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" in plan
