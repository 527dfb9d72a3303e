import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from autolot.llm import quality as Q
from autolot.llm.common import table
from tests.llm import samples


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    places, marked = {}, set()
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    for v in places.values():
        if len(v) > 1:
            for i in v:
                marked.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#|", max_size=120), max_size=6))
def test_statistics_of_any_text(texts):
    got = Q.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in Q.COUNTS[:5]) == brute(t)


def test_statistics_of_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = Q.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def test_learned_list_is_ordered_and_precise():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.1) & (x["a"] < 0.5))
    rules = Q.learn(x, bad)
    hit = np.any([Q._covers(r, x, 600) for r in rules], axis=0)
    assert len(rules) >= 2 and (hit == bad).mean() > 0.97
    assert Q.learn(x, rng.random(600) < 0.3) == [] and Q.learn(x, np.zeros(600, bool)) == []


def test_clean_documents_stay(spark, sf_dir):
    good = Q.query(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1 and not base_failed")
    assert good.where("not kept").count() <= 0.01 * good.count()


def test_odd_rows(spark, sf_dir):
    docs = samples.documents(spark)
    rows = Q.judge(Q.measure(docs, "doc_id"), []).collect()
    assert len(rows) == docs.count() and all(r.kept == (not r.base_failed) for r in rows)
    kept = Q.keep_good(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5, 6}
    assert Q.keep_good(spark, samples.empty(spark), sf_dir).count() == 0
    assert Q.fit(samples.empty(spark), spark.createDataFrame([], "doc_id long, quality int")) == []
