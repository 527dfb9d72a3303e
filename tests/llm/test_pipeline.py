import pytest

import corpus_pipeline as C
from autolot.llm import private, quality
from autolot.llm.common import materialize, table
from tests.llm.test_neardup import brute as classes
from tests.llm.test_packing import whole
from tests.llm.test_quality import brute as counts


def test_every_stage_against_brute_force(spark, sf_dir):
    assert [n for n, _ in C.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "packing"]
    docs = table(spark, sf_dir, "documents")
    schema, stage = docs.schema, dict(C.STAGES)

    kept = materialize(stage["quality rules"](spark, docs, sf_dir), "t")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    want = {r.doc_id for r in quality.judge(quality.measure(docs, "doc_id"), rules).where("kept").collect()}
    for r in docs.collect():
        n = counts(r.text)
        if n[0] < 20 or 100 * n[4] > 30 * n[0]:
            want.discard(r.doc_id)
    assert kept.schema == schema and {r.doc_id for r in kept.collect()} == want

    one = materialize(stage["near-duplicates"](spark, kept, sf_dir), "t")
    by = classes({r.doc_id: r.text for r in kept.collect()})
    assert one.schema == schema and sorted(r.doc_id for r in one.collect()) == sorted(set(by.values()))

    clean = materialize(stage["personal data"](spark, one, sf_dir), "t")
    chooser = private.fit(one)
    want = {r.doc_id: private.redact_text(r.text, sum(chooser.spans(r.text), [])) for r in one.collect()}
    assert clean.schema == schema and {r.doc_id: r.text for r in clean.collect()} == want
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    mixed = materialize(stage["mixing"](spark, clean, sf_dir), "t")
    assert mixed.schema == schema and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in clean.collect()}

    packed = materialize(stage["packing"](spark, mixed, sf_dir), "t")
    tokens, sequences = whole(mixed, packed)
    assert tokens / (sequences * 2048) > 0.97
    run = C.run(spark, sf_dir).select("doc_id", "start", "ids_crc32")
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, packed.select("doc_id", "start", "ids_crc32").collect()))


@pytest.mark.parametrize(("name", "module"), [("quality rules", quality), ("personal data", private)])
def test_texts_go_to_python_in_small_batches_whoever_runs_the_stage(spark, sf_dir, monkeypatch, name, module):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    docs = table(spark, sf_dir, "documents")
    many = docs.crossJoin(spark.range(15)).select(*docs.columns).coalesce(1)  # 3,000 rows in one task

    def small(batches):
        for batch in batches:
            assert batch.num_rows <= 1000, f"a batch of {batch.num_rows} rows"
            yield batch

    try:
        spark.conf.set(key, "10000")
        with monkeypatch.context() as m:
            m.setattr(module, "slim", small)
            rows = dict(C.STAGES)[name](spark, many, sf_dir)
            rows.write.format("noop").mode("overwrite").save()
        spark.conf.set(key, "300")
        dict(C.STAGES)[name](spark, docs, sf_dir)
        assert spark.conf.get(key) == "300"  # a smaller size stays
    finally:
        spark.conf.set(key, old)
