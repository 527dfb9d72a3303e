import random

import pytest

from autolot.llm import licenses as L
from tests.llm import samples

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
ALL = L.Templates.of(L.TEMPLATES)


def lcs(a, b):
    """Length and words of a longest common subsequence, plainly."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def brute(text, templates=ALL, near=L.NEAR, share=L.VOTES, least=L.LEAST):
    """The same, with words as strings and dictionaries of votes."""
    words = L.words_of(text or "")
    places = {}
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.setdefault(label, []).append(i)
    at = sorted(i for x in places.values() for i in x)
    spans = []
    for t, w in enumerate(templates.words):
        votes = {}
        for i in range(len(words) - 2):
            for j in range(len(w) - 2):
                if words[i : i + 3] == list(w[j : j + 3]):
                    votes.setdefault(i - j, set()).add(j)
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][1] <= near:
                groups[-1][1:] = [d, groups[-1][2] + len(votes[d])]
            else:
                groups.append([d, d, len(votes[d])])
        spans += [(t, lo - near, hi + len(w) + near) for lo, hi, n in groups if n >= max(1, -(-(len(w) - 2) * share // 1))]
    labels, score = L.verified(words, spans, templates, least)
    if spans:
        assert score == max(lcs(templates.words[t], words[max(0, lo) : hi]) / len(templates.words[t]) for t, lo, hi in spans)
    own = set(places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(own)), ",".join(sorted(own | labels)), 1.0 if at else score


def test_labels_of_notices():
    for label, notice, _ in L.TEMPLATES:
        assert brute(notice)[5].split(",")[-1] == label or label in brute(notice)[5].split(",")
        assert set(brute(f"some words before, {notice.upper()}! and after it")[5].split(",")) == {label}
    assert brute("This work is licensed under the GNU General Public License, version 3.")[5] == "gpl-3"
    assert brute("This work is licensed under the GNU General Public License, version 4.")[5:] == ("", 8 / 9)
    assert brute("Licensed under CC BY-NC 4.0. Released under the MIT License.")[4:] == ("cc-by-nc,mit", "cc-by-nc,mit", 1.0)
    assert brute("he has a license to drive under the terms of the law")[5] == ""


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        kind = rng.choice("swap drop add".split())
        words[i : i + 1] = {"swap": ["other"], "drop": [], "add": [words[i], "extra"]}[kind]
    return words


def texts():
    rng = random.Random(5)
    out = [None, "", "?!", "a b", "under the mit license " * 3, "UNDER THE MIT LICENSE é", "Apache License, Version 2.0 under the MIT\tlicense", "under the mit", "x under the mit license"]
    for k in range(60):
        label, notice, _ = rng.choice(L.TEMPLATES)
        body = samples.prose(k, rng.randrange(0, 60)).split()
        at = rng.randrange(len(body) + 1)
        out.append(" ".join(body[:at] + edited(rng, notice.split(), rng.randrange(0, 9)) + body[at:]))
    long = samples.prose(1, 30_000).split()
    long[7000:7000] = L.TEMPLATES[0][1].split()
    long[25_000:25_000] = L.TEMPLATES[7][1].split()
    return [*out, " ".join(long), " ".join(["permission is hereby granted"] * 500), L.TEMPLATES[0][1] + " " + L.TEMPLATES[0][1]]


def test_equal_to_brute_force(spark):
    rows = [(i, t, "a", 1, "b", 2) for i, t in enumerate(texts())]
    rows += [(None, rows[12][1], *rows[0][2:]), (3, rows[13][1], *rows[0][2:]), (3, None, *rows[0][2:])] + [rows[12]] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, template int, t1 string, place long").repartition(4)
    got = sorted(map(repr, (tuple(r) for r in L.scan(df).select(*COLUMNS).collect())))
    assert got == sorted(repr((r[0], *brute(r[1]))) for r in rows)
    assert any("isc" in r or "gpl-2" in r for r in got)


@pytest.mark.parametrize("kind", ["string", "struct<`a b`: int>"])
def test_ids_of_any_type(spark, kind):
    ident = "x" if kind == "string" else (1,)
    df = spark.createDataFrame([(ident, "under the mit license"), (None, "nothing")], f"doc_id {kind}, text string")
    assert sorted(r.labels for r in L.scan(df).collect()) == ["", "mit"]


def test_no_rows(spark):
    assert L.scan(samples.empty(spark)).count() == 0


def test_many_equal_texts_vote_once(spark):
    text = "Released under the MIT Licence, version gpl. " + L.TEMPLATES[1][1]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").crossJoin(spark.range(3000)).drop("id")
    got = L.scan(df).select("labels", "score").distinct().collect()
    assert [tuple(r) for r in got] == [("mit", 1.0)]


def test_planted_notices_of_the_given_table(spark, sf_dir):
    """The table's license lines are all found, and other texts have no label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in L.query(spark, sf_dir).collect()}
    planted = {"GNU General Public License, version 3": "gpl-3", "under the MIT License": "mit", "CC BY-NC": "cc-by-nc", "Apache License, Version 2": "apache-2"}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = sorted({v for k, v in planted.items() if k in (r.text or "")})
        assert got[r.doc_id].labels == ",".join(want), (r.doc_id, got[r.doc_id])
        assert tuple(got[r.doc_id])[:6] == (r.doc_id, *brute(r.text, L.Templates.of([]))[:5])
