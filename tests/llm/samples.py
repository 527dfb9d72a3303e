"""Small tables with all that can be odd in them."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, copy long, bands long, _doc string, n_words long, row string, score double, cell int"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    long = prose(1, 40_000)
    base = prose(2, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [None, "", "   \n\t ", long, base, base, near, "short text", "short text", "a", "12 +1 (612) 555-5827 x@y.example.com", prose(3, 60), "é" * 50, "\u0000 zero", prose(4, 30)]
    out = [(i, t, ["en", None, "fr"][i % 3], ["a", None, "b"][i % 3], None) for i, t in enumerate(texts)]
    out += [out[4], (None, "no key at all", "en", "a", 1), (None, None, None, None, None), (3, prose(5, 30), "fr", "a", 2)]
    return [(*r, "x", 1, 1, "y", 2, "z", 0.5, 3) for r in out]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
