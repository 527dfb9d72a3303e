"""License scans by diagonal voting.

All runs of K words of all texts are joined, by hash, with the places of the same runs in templates of licenses. A hit votes for
its diagonal, the place in the text less that in the template: a copy of a template votes for one diagonal, an edited one for
a few neighbouring ones. Votes are added up by text, template and diagonal; neighbouring diagonals are merged; the span of text
they point at is verified by the words that it shares with the template in order.

Texts are told apart by hashes of their content (128 bits with their length), so equal texts, however many, vote once and share one
verdict, and no number of a row has to be the same in two passes over the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autolot.llm.common import chunks, materialize, slim, strings, table, typed, utf8
from autolot.llm.graphs import maybe_broadcast
from autolot.llm.words import Words

# The phrases and labels of the base, and public notices of licenses (lower case, without signs).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, words of a notice, words without which it is another license's).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "deal restriction"),
    ("mit", "released under the mit license", "mit"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache 2"),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "general 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "general 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "general 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "general 3"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "lesser 2 1"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "lesser 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2"),
    ("mpl-2", "licensed under the mozilla public license version 2 0", "mozilla 2"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse 2"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "commons attribution"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "commons sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "commons noncommercial"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "commons noderivatives"),
]

#: Words of a run; diagonals so close are one span's; the least share of a template's words in it; the least share of votes.
K, NEAR, LEAST, VOTES = 3, 4, 0.8, 0.25
LETTER = np.zeros(256, bool)
LETTER[0x30:0x3A] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_UPPER))


def hashed(texts: pa.Array) -> Words:
    """The words of a batch's texts, A-Z lower-cased."""
    data, at = utf8(texts)
    return Words(LOWER[data], at, ~LETTER)


def runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all runs of k words within a row, their hashes as longs, and each row's first run."""
    at, h = words.windows(k)
    return at, h.view(np.int64), np.searchsorted(at, words.first)


@dataclass(frozen=True)
class Templates:
    """Templates as words, and the places of their runs of `k` words."""

    labels: tuple[str, ...]
    words: tuple[tuple[str, ...], ...]
    needed: tuple[frozenset[str], ...]
    k: int = K

    @staticmethod
    def of(rows: list[tuple[str, str, str]], k: int = K) -> Templates:
        return Templates(tuple(r[0] for r in rows), tuple(tuple(words_of(r[1])) for r in rows), tuple(frozenset(words_of(r[2])) for r in rows), k)

    def places(self, spark: SparkSession) -> DataFrame:
        """h, template, at: a row for each run of each template. Of the size of the templates."""
        at, h, first = runs(hashed(pa.array([" ".join(w) for w in self.words])), self.k)
        start = hashed(pa.array([" ".join(w) for w in self.words])).first
        rows = [(int(h[i]), t, int(at[i] - start[t])) for t in range(len(self.words)) for i in range(first[t], first[t + 1])]
        return spark.createDataFrame(rows, "h long, template int, at int")


def content(text: Column) -> list[Column]:
    """What tells texts apart: two hashes of 64 bits and the length; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(11), text, F.octet_length(text)).alias("t2")]


def shared(template: tuple[str, ...], span: list[str]) -> tuple[int, set[str]]:
    """The longest common subsequence of words, as its length, and the template's words found in the span in that order."""
    n = len(template)
    table = np.zeros((n + 1, len(span) + 1), np.int32)
    code = {w: i for i, w in enumerate(dict.fromkeys(template))}
    b = np.array([code.get(w, -1) for w in span])
    for i, w in enumerate(template):
        hit = b == code[w]
        # cell j: the best of above, of left, and of one more than above left where words agree
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(hit, table[i, :-1] + 1, 0)))
    found, i, j = set(), n, len(span)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.add(template[i])
    return int(table[n, len(span)]), found


def verified(words: list[str], spans: list[tuple[int, int, int]], templates: Templates, least: float) -> tuple[set[str], float]:
    """Labels of a text, and the highest similarity of any span.

    A span's similarity is the share of its template's words that it holds in order. It counts if that is `least` or more and no
    needed word is missing. Of spans that overlap, the most similar one names the license (then the one of the longer template, then the first).
    """
    judged, top = [], 0.0
    for t, lo, hi in spans:
        lo, hi = max(0, lo), min(len(words), hi)
        if lo >= hi:
            continue
        length, found = shared(templates.words[t], words[lo:hi])
        likeness = length / len(templates.words[t])
        top = max(top, likeness)
        if likeness >= least and templates.needed[t] <= found:
            judged.append((-likeness, -len(templates.words[t]), t, lo, hi))
    labels, taken = set(), []
    for *_, t, lo, hi in sorted(judged):
        if all(hi <= a or b <= lo for a, b in taken):
            labels.add(templates.labels[t])
            taken.append((lo, hi))
    return labels, top


def _phrases(words: Words, phrases: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Places of the base's phrases: sorted words of the batch where one starts, and for each label its own."""
    each = {}
    for phrase, label in phrases.items():
        wanted = hashed(pa.array([phrase])).hash
        n = len(words.hash) - len(wanted) + 1
        ok = np.ones(max(n, 0), bool)
        for i, h in enumerate(wanted):
            ok &= words.hash[i : i + len(ok)] == h
        at = np.flatnonzero(ok)
        row = np.searchsorted(words.first, at, "right") - 1
        at = at[at + len(wanted) <= words.first[row + 1]]
        each.setdefault(label, []).append(at)
    each = {label: np.sort(np.concatenate(at)) for label, at in each.items()}
    return np.sort(np.concatenate(list(each.values()))) if each else np.zeros(0, np.int64), each


def scan(docs: DataFrame, templates: Templates | None = None, phrases: dict[str, str] | None = None, least: float = LEAST, near: int = NEAR, votes: float = VOTES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of `docs` (doc_id, text).

    Words are runs of letters, digits and other characters beyond ASCII, A-Z lower-cased. The base counts the places where a phrase's
    words stand one after another; places of different phrases that start at the same word count apart. `labels` adds those of
    templates found by diagonal voting. `score` is 1 with a base label, else the highest similarity of any span that was voted for, 0 without.

    A null text is empty: no words, no labels, score 0. Repeated rows and rows with equal ids stay apart and get the same
    result; doc_id may be of any type and null; other columns are ignored. An empty table gives no rows.
    """
    templates, phrases = templates or Templates.of(TEMPLATES), PHRASES if phrases is None else phrases
    spark, k = docs.sparkSession, templates.k
    kind = typed(docs.schema["doc_id"].dataType)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *content(F.col("text")))

    def read(batches):
        for batch in slim(batches):
            texts = strings(batch.column(1))
            for lo, hi in chunks(texts):
                part, words = batch.slice(lo, hi - lo), hashed(texts.slice(lo, hi - lo))
                at, each = _phrases(words, phrases)
                first = np.searchsorted(at, words.first)
                number = np.diff(first)
                has = number > 0
                start, end = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
                start[has], end[has] = at[first[:-1][has]] - words.first[:-1][has], at[first[1:][has] - 1] - words.first[:-1][has]
                labels = [[] for _ in number]
                for label in sorted(each):
                    for row in np.unique(np.searchsorted(words.first, each[label], "right") - 1).tolist():
                        labels[row].append(label)
                _, h, run = runs(words, k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), part.column(3), pa.array(np.diff(words.first)), pa.array(number), pa.array(start, mask=~has), pa.array(end, mask=~has), pa.array([",".join(x) for x in labels]),
                    pa.ListArray.from_arrays(pa.array(run.astype(np.int32)), pa.array(h)),
                ], ["doc_id", "t1", "t2", "n_words", "n_base", "first_word", "last_word", "base_labels", "runs"])

    fields = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    read_as = f"doc_id {kind}, t1 long, t2 long, n_words long, n_base long, first_word long, last_word long, base_labels string, runs array<long>"
    texts = rows.select("doc_id", "text", "t1", "t2").mapInArrow(read, read_as)
    # One pass gives the row itself (place -1) and the places of its runs; of these, only those of a template are left.
    whole = texts.select(*fields, "t1", "t2", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "runs")).alias("place", "h"))
    joined = whole.join(F.broadcast(templates.places(spark)), "h", "left").where("place = 0 or template is not null")
    found = materialize(joined.select(*fields, "t1", "t2", (F.col("place") - 1).alias("place"), "template", "at"), "runs")
    base, hits = found.where("place = -1").select(*fields, "t1", "t2"), found.where("place >= 0").select("t1", "t2", "template", "place", "at")

    # Votes by diagonal; equal texts vote once.
    diagonal = hits.withColumn("d", F.col("place") - F.col("at")).groupBy("t1", "t2", "template", "d", "at").agg(F.lit(1).alias("one")).groupBy("t1", "t2", "template", "d").agg(F.count("*").alias("n"))
    order = Window.partitionBy("t1", "t2", "template").orderBy("d")
    apart = (F.col("d") - F.lag("d").over(order) > near).cast("int")
    merged = diagonal.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("span", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("t1", "t2", "template", "span").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("n").alias("n"))
    sizes = [len(w) for w in templates.words]
    length = F.element_at(F.array(*map(F.lit, sizes)), F.col("template") + 1)
    enough = F.col("n") >= F.greatest(F.lit(1), F.ceil((length - (k - 1)) * votes))
    spans = merged.where(enough).groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("template", F.col("lo").cast("long").alias("lo"), (F.col("hi") + length).cast("long").alias("hi")))).alias("spans"))  # of one text
    spans = materialize(spans, "spans")

    def verify(batches):
        for batch in slim(batches):
            out = [verified(words_of(t), [(x["template"], x["lo"] - near, x["hi"] + near) for x in s], templates, least) for t, s in zip(strings(batch.column(0)).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([sorted(x[0]) for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.float64())], ["t1", "t2", "more", "likeness"])

    candidates = rows.join(maybe_broadcast(spans), ["t1", "t2"]).select("text", "t1", "t2", "spans")
    judged = candidates.mapInArrow(verify, "t1 long, t2 long, more array<string>, likeness double").groupBy("t1", "t2").agg(F.max("more").alias("more"), F.max("likeness").alias("likeness"))
    judged = materialize(judged, "verified")
    out = base.join(maybe_broadcast(judged), ["t1", "t2"], "left")
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    both = F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(*fields, F.array_join(both, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("likeness", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
