import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from autolot.llm import language as L
from autolot.llm.common import table
from tests.llm import samples


def brute_bits(model_texts, text, often):
    """PPM with exclusion by plain dictionaries, for one language and depth 3."""
    counts = {}
    for t in model_texts:
        b = b"\n\n\n" + t.encode()
        for i in range(3, len(b)):
            for d in range(4):
                counts.setdefault(b[i - d : i], {}).setdefault(b[i], 0)
                counts[b[i - d : i]][b[i]] += 1

    def p(ctx, x):
        own = counts.get(ctx, {})
        if len(ctx) == 3 and ctx not in often:
            own = {}
        if not ctx:
            lower = lambda y: 1 / 256
        else:
            lower = lambda y: p(ctx[1:], y)
        if not own:
            return lower(x)
        n, d = sum(own.values()), len(own)
        left = 1 - sum(lower(y) for y in own)
        escape = d / (n + d) if left > 1e-12 else 0
        return own[x] / n * (1 - escape) if x in own else escape * lower(x) / left

    b = b"\n\n\n" + text.encode()
    return sum(-np.log2(p(b[i - 3 : i], b[i])) for i in range(3, len(b)))


def contexts(texts):
    """Contexts of three bytes that some language has often enough."""
    out = set()
    for own in texts.values():
        n = Counter(b[i - 3 : i] for b in (b"\n\n\n" + t.encode() for t in own) for i in range(3, len(b)))
        out |= {c for c, k in n.items() if k >= L.LEAST_COUNT}
    return out


def test_code_lengths_equal_plain_ppm(monkeypatch):
    texts = {"aa": ["the cat sat on the mat", "the dog the cat"], "bb": ["le chat et le chien", "un été à la mer the"]}
    found = [(lang, row) for lang, ts in texts.items() for row in ts]
    grams = {}
    for batch in L._grams([pa.RecordBatch.from_arrays([pa.array([r for _, r in found]), pa.array([x for x, _ in found])], ["text", "lang"])]):
        for lang, g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            grams.setdefault(lang, {})[g] = n
    model = L.Model(sorted(grams), [np.array(sorted(grams[x])) for x in sorted(grams)], [np.array([grams[x][g] for g in sorted(grams[x])], float) for x in sorted(grams)])
    cases = ["the mat", "un chat", "zzz", "é", "", "the the the cat sat", "the chat et the mer " * 40]
    often = contexts(texts)
    assert any(sum(t.encode().count(c) for t in texts["aa"]) >= L.LEAST_COUNT > sum(t.encode().count(c) for t in texts["bb"]) > 0 for c in often)  # known in one language, seen in the other
    want = [[brute_bits(texts[x], text, often) for x in sorted(grams)] for text in cases]
    for window in (L.WINDOW, 7):
        monkeypatch.setattr(L, "WINDOW", window)
        assert np.allclose(model.lengths(pa.array(cases)), want, rtol=1e-9)


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = L.identify(docs, L.fit(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert len(held) and (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_odd_rows(spark):
    docs = samples.documents(spark)
    got = {(r.doc_id, i): r for i, r in enumerate(L.identify(docs, L.fit(docs)).collect())}
    assert len(got) == docs.count()
    assert all(r.lang_pred == "und" for r in got.values() if r.doc_id in (0, 1, 2))
    assert L.fit(samples.empty(spark)) is None
    assert L.identify(samples.empty(spark), None).count() == 0
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}


def test_learning_does_not_hang_on_ids(spark):
    """All ids null, all equal, and one language's equal: every language is learned; one hot document does not make the sample."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    F = L.F
    langs = sorted(r.lang for r in docs.where("lang is not null").select("lang").distinct().collect())
    hot = F.when(F.col("lang") == langs[0], 1).otherwise(F.col("doc_id"))
    rows = docs.where("lang is not null and length(text) > 200")
    right = lambda model: L.identify(rows, model).join(rows, "doc_id").where("lang_pred = lang").count() / rows.count()
    usual = right(L.fit(docs, sample_docs=200))
    for ident in (F.lit(None).cast("long"), F.lit(1).cast("long"), hot.cast("long")):
        model = L.fit(docs.withColumn("doc_id", ident).join(spark.range(4).select(F.col("id").alias("copy"))), sample_docs=800)
        assert model.langs == langs and right(model) > usual - 0.005
    one = spark.createDataFrame([(1, "the only text of this language", "xx")], docs.schema).join(spark.range(5000)).drop("id")
    assert L.fit(docs.unionByName(one), sample_docs=20).langs == sorted([*langs, "xx"])


def test_counts_do_not_grow_with_partitions_or_batches(spark, monkeypatch):
    """The sample's strings are given once by each of its tasks, whatever the session shuffles to and sends at once."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    made, given = [], type(docs).mapInArrow

    def noted(self, *args, **more):
        made.append(given(self, *args, **more))
        return made[-1]

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    old = {k: spark.conf.get(k) for k in keys}
    rows, models = [], []
    try:
        for values in (("4", "true", "10000"), ("200", "false", "10000"), ("4", "true", "10")):
            for k, v in zip(keys, values, strict=True):
                spark.conf.set(k, v)
            models.append(L.fit(docs, sample_docs=100))
            rows.append(made[-1].count())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rows[0] <= rows[1] <= 2 * rows[0] and rows[2] == rows[0]  # about 400 documents ask for two tasks at most; a single one gives each string once
    for m in models[1:]:
        assert m.langs == models[0].langs and all(np.array_equal(x, y) for x, y in zip(m.key + m.cost, models[0].key + models[0].cost, strict=True))


def test_very_many_strings_are_given_in_parts(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["the cat sat", "on the mat", "the end"]), pa.array(["en"] * 3)], ["text", "lang"])

    def total(found):
        out = Counter()
        for part in found:
            for g, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                out[g] += n
        return out

    whole = list(L._grams([batch, batch]))
    monkeypatch.setattr(L, "MOST_STRINGS", 3)
    parts = list(L._grams([batch, batch]))
    assert len(whole) == 1 and len(parts) == 2 and total(whole) == total(parts)
    assert list(L._grams([])) == []
