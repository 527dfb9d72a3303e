"""Similarity of names against plain Python, and how many pairs are compared for it."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from autolot.operators import matching, similarity


def indel(a, b):
    """By the table, a row at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def bits(a, b):
    """The same by the bits of one integer, for a comparison of speed."""
    place, full = {}, (1 << len(a)) - 1
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b)) if a or b else 100.0


def token_set(a, b):
    x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max([indel(left, right), *((indel(both, left), indel(both, right)) if both else ())])


def word(rng, letters, least, most):
    return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))


def test_ratios_of_names_of_any_length():
    rng = random.Random(2)
    pairs = [tuple(word(rng, "abcé 2中\U0001f697", n, n) for n in rng.choices([0, 1, 5, 12, 63, 64, 65, 127, 128, 129, 200], k=2)) for _ in range(400)]
    pairs += [("", ""), ("x" * 300, "x" * 300), ("ab" * 100, "ba" * 100)]
    a, b = map(list, zip(*pairs, strict=True))
    want = [indel(x, y) for x, y in pairs]
    assert all(abs(x - y) < 1e-12 for x, y in zip(similarity.ratios(a, b), want, strict=True))
    for least in (20, 50, 90, 100):
        got = similarity.ratios(a, b, least)
        assert all(math.isnan(x) if y < least else abs(x - y) < 1e-12 for x, y in zip(got, want, strict=True))
    got = similarity.ratios(["a", None, None], [None, "b", None])
    assert all(map(math.isnan, got)) and len(similarity.ratios([], [])) == 0


def test_token_sets():
    rng = random.Random(3)
    words = [word(rng, "abcd", 1, 4) for _ in range(25)] + ["É", "x1", "_"]
    pairs = [tuple(rng.choice(["", " ", ", "]) + rng.choice([" ", "-", "  "]).join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(2)) for _ in range(600)]
    pairs += [("clio IV dci", "dci clio"), ("a", "b"), ("", ""), ("", "a"), (" ", "!")]
    a, b = map(list, zip(*pairs, strict=True))
    assert all(abs(x - token_set(*p)) < 1e-12 for x, p in zip(similarity.token_sets(a, b), pairs, strict=True))
    assert math.isnan(similarity.token_sets([None], ["a"])[0])


def test_batches_are_faster_than_single_pairs():
    rng = random.Random(4)
    pool = [word(rng, "abcdefghijkl ", 4, 14) for _ in range(2000)]
    a, b = rng.choices(pool, k=200_000), rng.choices(pool, k=200_000)
    start = time.process_time()
    got = similarity.ratios(a, b)
    batch, start = time.process_time() - start, time.process_time()
    want = [bits(x, y) for x, y in zip(a, b, strict=True)]
    assert got.tolist() == want and 4 * batch < time.process_time() - start


def counted(monkeypatch, name, seen):
    """Let a step of `similarity` count the rows that it gives."""
    plain = getattr(similarity, name)

    def run(*args):
        out = plain(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(similarity, name, run)


def test_first_similar_equals_all_pairs(spark):
    rng = random.Random(5)
    left = [(rng.choice("pq"), word(rng, "abcdef", 0, 9)) for _ in range(150)] + [(None, "abc"), ("p", None), ("z", "abc"), ("p", "")]
    right = [(rng.choice("pq"), word(rng, "abcdxyz", 0, 9), i) for i in range(300)] + [("p", "", 900), (None, "abc", 0), ("p", None, 0)]
    for least in (40.0, 50.0, 75.0, 100.0):
        want = {}
        for b, m in left:
            hits = [h for c, o, h in right if b is not None and b == c and m is not None and o is not None and indel(m, o) >= least]
            if hits:
                want[b, m] = min(hits)
        for rounds in ((2, 10), (), (1000,)):
            got = similarity.first_similar(spark.createDataFrame(left, "b string, m string"), spark.createDataFrame(right, "b string, other string, i int"), "b", "m", "other", "i", least, rounds)
            assert {(r.b, r.m): r.i for r in got.collect()} == want
    pairs = {(r.b, r.m, r.other): round(r.ratio, 9) for r in similarity.similar_pairs(spark.createDataFrame(left, "b string, m string"), spark.createDataFrame(right, "rb string, other string, i int"), "b", "m", "rb", "other", 60.0).collect()}
    assert pairs == {(b, m, o): round(indel(m, o), 9) for b, m in left for c, o, _ in right if b is not None and b == c and m is not None and o is not None and indel(m, o) >= 60}


def test_few_pairs_of_a_large_brand_are_compared(spark, monkeypatch):
    """One brand: most names are like some early one, others like none at all. Pairs do not go with the square of the names."""
    rng = random.Random(6)
    left = list({word(rng, "abcdefghijklmnopqrstuvwxyz", 5, 9) for _ in range(6000)}) + [f"{i:06}" for i in range(0, 6000, 7)]
    right = [(word(rng, "abcdefghijklmnopqrstuvwxyz", 5, 9), i) for i in range(6000)]
    seen = []
    counted(monkeypatch, "met", seen)
    sizes, write = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, name: sizes.append((name, (out := write(df, name)).count())) or out)
    got = similarity.first_similar(spark.createDataFrame([("b", x) for x in left], "b string, m string"), spark.createDataFrame([("b", x, i) for x, i in right], "b string, other string, i int"), "b", "m", "other", "i").collect()
    asked = [n for name, n in sizes if name == "asked"]  # before each round, and what is left after the last
    compared = sum(n * k for n, k in zip(asked, (64, 192, 768), strict=False)) + sum(seen)
    assert compared < len(left) * len(right) / 8 and compared < 1024 * len(left) and sum(seen) < 20 * len(left), (asked, seen)
    sample = rng.sample(left, 60)
    by = {r.m: r.i for r in got}
    for m in sample:
        assert by.get(m) == min((i for o, i in right if indel(m, o) >= 50), default=None)


def cosines(left, right, top):
    def grams(name):
        padded = f" {name.lower()} "
        return {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}

    known = {(b, o): grams(o) for b, o in right}
    names = {o for _, o in known}
    df = Counter(g for o in names for g in grams(o))
    w = {g: math.log((len(names) + 1) / (n + 1)) ** 2 for g, n in df.items()}
    out, pairs = {}, 0
    norm = {k: math.sqrt(sum(w[g] for g in v)) for k, v in known.items()}
    blocks = {}
    for (b, o), g in known.items():
        blocks.setdefault(b, []).append((o, g))
    for b, m in left:
        own = grams(m) & set(w)
        n = math.sqrt(sum(w[g] for g in own))
        rows = [(-round(sum(w[g] for g in sorted(own & g2)) / (n * norm[b, o]) if n * norm[b, o] else 0.0, 9), o) for o, g2 in blocks.get(b, ()) if own & g2]
        pairs += len(rows)
        out[b, m] = sorted(rows)[:top]
    return out, pairs


def test_cosine_top_equals_all_pairs(spark, monkeypatch):
    """2,000 names of a brand, all with the brand's own trigrams, and small brands beside it."""
    rng = random.Random(7)
    stems = [word(rng, "abcdefghijklmnopqrstuvwxyz0123456789", 3, 7) for _ in range(700)]
    name = lambda b: f"{b} {rng.choice(stems)} {rng.choice(['', 'gti', 'sw', 'plus', rng.choice(stems)])}".strip()
    left = list({("peugeot", name("peugeot")) for _ in range(300)} | {("kia", name("kia")) for _ in range(20)} | {("x", "nothing alike"), ("kia", "zzz"), ("none", "abc")})
    right = list({("peugeot", name("peugeot")) for _ in range(2000)} | {("kia", name("kia")) for _ in range(15)} | {("x", "other"), ("x", "name")})
    seen = []
    counted(monkeypatch, "_together", seen)
    for top in (20, 200):
        seen.clear()
        got = {}
        for r in similarity.cosine_top(spark.createDataFrame(left, "b string, m string"), spark.createDataFrame(right, "rb string, other string"), "b", "m", "rb", "other", top).collect():
            got.setdefault((r.b, r.m), []).append((-r.cosine, r.other))
        want, pairs = cosines(left, right, top)
        for k, rows in want.items():
            mine = sorted(got.get(k, []))
            assert [o for _, o in mine] == [o for _, o in rows] or all(abs(a[0] - b[0]) < 2e-9 for a, b in zip(mine, rows, strict=True)), k
        if top == 20:
            assert sum(seen) < pairs / 2, (seen, pairs)


def test_two_stage(spark):
    names = spark.createDataFrame([("p", "peugeot 208 gt"), ("p", "peugeot zzz"), (None, "a")], "b string, name string")
    known = spark.createDataFrame([("p", "peugeot 208", 1), ("p", "peugeot 508 sw", 2), ("p", None, 0)], "b string, other string, i int")
    got = {r["name"]: (r["i"], r["status"]) for r in similarity.two_stage(names, known, "b", "name", "other", "i").collect()}
    assert got == {"peugeot 208 gt": (1, "auto"), "peugeot zzz": (got["peugeot zzz"][0], "reject")}
    left = spark.createDataFrame([("p", "208"), ("p", "clio"), ("q", "208")], "b string, m string")
    right = spark.createDataFrame([("p", "208 ii", 5), ("p", "2008", 3), ("p", "x", 1)], "b string, other string, i int")
    assert sorted(map(tuple, similarity.first_similar(left, right, "b", "m", "other", "i").collect())) == [("p", "208", 3)]


def test_names_that_begin_alike_do_not_meet(spark):
    """10,000 names of one beginning: few pairs beyond the true ones are compared."""
    texts = spark.range(10_000).select(F.lit("b").alias("block"), F.concat(F.lit("modele serie "), F.conv("id", 10, 36), F.lit("q"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(" gti")).alias("text"))
    parts = texts.select(F.col("block").alias("pb"), F.substring("text", 1, 20).alias("part")).distinct()
    pairs = matching.candidates(texts, parts, "block", "text", "pb", "part").count()
    true = matching.containing(texts, parts, "block", "text", "pb", "part").count()
    assert true >= 10_000 and pairs <= 2 * true, (pairs, true)


def test_a_long_name_does_not_multiply_titles(spark):
    """A dictionary name of 500 words: a title still gives a row for each of its words, and what is found does not change."""
    models = spark.createDataFrame([("golf",), ("golf gti",), ("gti",), (" ".join(f"w{i}" for i in range(500)),), ("series-3",), ("3",), ("golf golf",), (None,), ("!!",)], "m string")
    titles = ["VW Golf GTI 2.0", "minigolf gti", "golf-gti", "golf  gti", "Series-3 (gti)", "golfs", "gti golf golf gti", "", None, "w0 w1", " ".join(f"w{i}" for i in range(-3, 502))]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    got = {r.i: r.m for r in matching.longest_model(df, models, "i", "t", "m").collect()}
    assert got == {0: "golf gti", 1: "gti", 2: "golf", 3: "golf", 4: "series-3", 6: "golf golf", 10: " ".join(f"w{i}" for i in range(500))}
    filed = matching.filed_models(models, "m").collect()
    assert len(filed) == 7 and max(Counter(r["_word"] for r in filed).values()) <= 2
