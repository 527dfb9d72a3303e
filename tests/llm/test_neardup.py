import random
from collections import Counter, defaultdict

import numpy as np

from autolot.llm import neardup as N
from autolot.llm.common import table
from autolot.llm.graphs import components
from tests.llm import samples


def shingle_list(t):
    w = t.split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(texts):
    """Class of each text by all pairs of different texts, with the similarity of their shingles' counts."""
    uniq = sorted(set(texts.values()))
    sets = [frozenset((x, k) for x, n in Counter(shingle_list(t)).items() for k in range(n)) for t in uniq]
    root = list(range(len(uniq)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j in set().union(*(by[x] for x in s)) if s else ():
            if j < i and len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    group = defaultdict(list)
    for k, t in texts.items():
        group[find(uniq.index(t))].append(k)
    return {k: min(g) for g in group.values() for k in g}


def test_classes_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.class_id for r in N.query(spark, sf_dir).collect()} == want


def test_star_of_copies_over_blocks(spark):
    """One original with copies that are far from each other, more than a block holds."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    texts = {0: " ".join(base)}
    for k in range(1, 90):
        w = list(base)
        for p in rng.sample(range(400), rng.choice([4, 9, 60])):
            w[p] = f"x{rng.randrange(10_000)}"
        texts[k] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = N.materialize(N.signed(docs), "signed")
    want = brute(texts)
    roots = {r.node: r.root for r in components(N.links(docs, rows, block=16, block_bytes=20_000)).collect()}
    got = defaultdict(set)
    for r in rows.collect():
        got[roots.get(r.node, r.node)].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(k for k in want if want[k] == c) for c in set(want.values()))


def test_copies_of_one_text_are_compared_with_it_alone(spark, monkeypatch):
    """Copies that are near the original but not each other: the texts that are sent go with the copies, not with their square."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    texts = [(0, " ".join(base))]
    for k in range(1, 2500):
        w = list(base)
        w[rng.randrange(5, 55)] = f"x{k}"
        texts.append((k, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sent, plain = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: sent.append(df.count() if name in ("spokes", "wanted") else 0) or plain(df, name))
    assert {r.class_id for r in N.classes(docs).collect()} == {0}
    assert len(texts) <= sum(sent) < 6 * len(texts)


def test_samples_agree_with_weighted_jaccard():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    b[:200] = a[:200]
    h = np.concatenate([np.repeat(a, 2), b])
    row = np.repeat([0, 1], [600, 300])
    row, e, w = N.elements(row, h, "count")
    sig = N.signatures(row, e, w, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 200 / 700) < 0.03  # sum of minima over sum of maxima
    row, e, w = N.elements(np.repeat([0, 1], [600, 300]), h, "set")
    sig = N.signatures(row, e, w, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 200 / 400) < 0.03


def test_samples_agree_for_real_weights():
    rng = np.random.default_rng(6)
    e = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    a, b = rng.gamma(1, 1.5, 400), rng.gamma(1, 1.5, 400)
    a[:100], b[300:] = 0, 0
    row, both, weight = np.repeat([0, 1], 400), np.concatenate([e, e]), np.concatenate([a, b])
    some = weight > 0
    sig = N.signatures(row[some], both[some], weight[some], 2, 6000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


def test_similarity_of_weighted_sets():
    texts = ["a b c d e f g", "a b c d e f g", "a b c d e x y z a b c d e", "", "short one", "x y z " * 30]
    for weighting in ("set", "count"):
        sets = N.Sets(texts, weighting)
        for i, x in enumerate(texts):
            for j, y in enumerate(texts):
                p, q = (Counter(shingle_list(t)) if weighting == "count" else Counter(set(shingle_list(t))) for t in (x, y))
                assert abs(sets.similarity(i, j) - sum((p & q).values()) / max(1, sum((p | q).values()))) < 1e-12


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(f"{a:03}", f"{b:03}") for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150))] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    loose = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: find(x) for x in root if x not in loose}


def test_odd_rows(spark):
    docs = samples.documents(spark)
    rows = N.classes(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.class_id for r in rows if r.doc_id not in (None, 3)}
    assert got[5] == got[6] == 4 and got[8] == 7 and got[0] == 0 and got[1] == 1 and got[2] == 2
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and ids.count(5) == ids.count(6) == ids.count(8) == 0 and ids.count(0) == 1
    assert N.classes(samples.empty(spark)).count() == 0 and N.keep_one(samples.empty(spark)).count() == 0


def test_one_row_of_each_class_not_of_each_id(spark):
    """Ids that are null or repeated: different texts stay, copies go."""
    docs = samples.documents(spark)
    texts = {r.text for r in docs.where("doc_id = 3").collect()}
    assert len(texts) == 2 and {r.text for r in N.keep_one(docs).where("doc_id = 3").collect()} == texts

    a, b, c, d, e, f = (samples.prose(s, 60) for s in range(20, 26))
    near = lambda t: t.replace(t.split()[0], "changed", 1)
    rows = [(None, a), (None, b), (None, b), (None, c), (None, near(c)), (None, d), (9, near(d)), (7, e), (7, near(e)), (8, e), (7, f), (7, f), (None, None), (None, None), (7, None)]
    kept = [tuple(r) for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept[k][0] or 0 for k in range(len(kept)) if kept[k][1] is not None) == [0, 0, 0, 7, 7, 9]
    assert [t for i, t in kept].count(a) == [t for i, t in kept].count(b) == 1 and (9, near(d)) in kept and kept.count((7, f)) == 1
    assert len({c, near(c)} & {t for i, t in kept}) == len({e, near(e)} & {t for i, t in kept}) == 1
    assert kept.count((None, None)) == 2 and kept.count((7, None)) == 1


def test_one_text_a_node_however_often_it_is_repeated(spark, monkeypatch):
    """3,000 copies without an id, and near copies of them: each different text reaches the comparisons once."""
    a = samples.prose(70, 80)
    b = a.replace(a.split()[40], "changed", 1)
    rows = [(None, a)] * 3000 + [(4, b)] * 50 + [(5, samples.prose(71, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, plain = [], N._texts
    monkeypatch.setattr(N, "_texts", lambda *x: sizes.append((t := plain(*x)).count()) or t)
    got = {tuple(r) for r in N.classes(docs).select("doc_id", "class_id").collect()}
    assert sizes == [2] and got == {(None, 4), (4, 4), (5, 5)}
