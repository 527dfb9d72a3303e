"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of depth 3 is grown from a bounded sample of labelled documents, then
frozen. A byte's probability is that of the longest known context, where the escape probability (method
C: d / (n + d) for n occurrences of d different bytes) is shared among the bytes that the context has
not seen, in proportion to the next shorter context; below order 0 all 256 bytes are equal. As the
statistics are frozen, -log2 of these probabilities can be tabled for each known context. A text's code
length under a language is the sum over its bytes; the shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autolot.llm.common import chunks, slim, spread, strings, table, typed, utf8

#: Documents sampled for each language, as expected; all are taken where there are fewer.
SAMPLE_DOCS = 400
#: Documents of the sample that are counted in one task, as expected.
DOCS_A_TASK = 250
#: Different strings that a task counts before it gives them.
MOST_STRINGS = 1 << 20
#: A context of three bytes is kept if some language has it so often.
LEAST_COUNT = 3
DEPTH = 3
#: Bytes scored at a time.
WINDOW = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with DEPTH line feeds before each row, and the rows' offsets in that."""
    rows = len(at) - 1
    out = np.full(len(data) + DEPTH * rows, 10, np.uint8)
    out[np.arange(len(data)) + DEPTH * (1 + np.repeat(np.arange(rows), np.diff(at)))] = data
    return out, at + DEPTH * np.arange(rows + 1)


def _grams(batches):
    """Counts of four-byte strings by language, one for each task; where there are very many strings, some more."""
    counts: dict[str, dict] = {}
    for batch in slim(batches):
        texts, langs = strings(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
        for a, b in chunks(texts):
            for lang in set(langs[a:b]):
                data, at = utf8(texts.slice(a, b - a).filter(pa.array(langs[a:b] == lang)))
                data, at = _padded(data, at)
                x = data.astype(np.uint32)
                gram = x[3:] | x[2:-1] << 8 | x[1:-2] << 16 | x[:-3] << 24
                real = np.ones(len(gram), bool)  # not those that end in the next row's padding
                for k in range(DEPTH):
                    cut = at[1:-1] - DEPTH + k
                    real[cut[cut < len(real)]] = False
                found, n = np.unique(gram[real], return_counts=True)
                own = counts.setdefault(lang, {})
                for g, c in zip(found.tolist(), n.tolist(), strict=True):
                    own[g] = own.get(g, 0) + c
            if sum(map(len, counts.values())) > MOST_STRINGS:
                yield from _given(counts)
                counts = {}
    yield from _given(counts)


def _given(counts: dict[str, dict]):
    for lang, own in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


class Model:
    """Tabled code lengths of seen contexts only; what a context has not seen costs its escape and the next shorter context's length.

    For each order d, `key[d]` holds the seen strings of d + 1 bytes in order, and `cost[d]` their last bytes' lengths in bits
    after the d bytes before, with a column for each language; `context[d]` and `escape[d]` hold the contexts and what leaving
    them costs (0 where a language does not know them). So the tables go with the strings of the sample, and not with
    all pairs of bytes and contexts.
    """

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.langs = langs
        self.key: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.context: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        shorter = np.full((256, len(langs)), 1 / 256)
        for d in range(DEPTH + 1):
            own = [g & ((1 << 8 * (d + 1)) - 1) for g in grams]
            key = np.unique(np.concatenate(own))
            n = np.stack([np.bincount(np.searchsorted(key, g), c, minlength=len(key)) for g, c in zip(own, counts, strict=True)], 1)
            if d == DEPTH:
                context, at = np.unique(key >> 8, return_inverse=True)
                often = self._sums(at, n, len(context)).max(1) >= LEAST_COUNT
                key, n = key[often[at]], n[often[at]]
            context, at = np.unique(key >> 8, return_inverse=True)
            lower = shorter if d == 0 else shorter[np.searchsorted(self.key[d - 1], key & ((1 << 8 * d) - 1))]
            if d == 0:
                n = np.stack([np.bincount(g, c, minlength=256) for g, c in zip(own, counts, strict=True)], 1)
                key, context, at = np.arange(256), np.zeros(1, np.int64), np.zeros(256, np.int64)
            total, kinds = self._sums(at, n, len(context)), self._sums(at, n > 0, len(context))
            left = np.maximum(0, 1 - self._sums(at, np.where(n > 0, lower, 0), len(context)))
            leave = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0) * (left > 1e-12)
            rest = np.where(total > 0, leave / np.where(left > 0, left, 1), 1.0)
            p = np.where(n > 0, n / np.maximum(total, 1)[at] * (1 - leave)[at], rest[at] * lower)
            self.key.append(key.astype(np.int64))
            self.context.append(context.astype(np.int64))
            self.cost.append(-np.log2(np.maximum(p, 1e-30)))
            self.escape.append(-np.log2(np.maximum(rest, 1e-30)))
            shorter = p

    @staticmethod
    def _sums(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
        return np.stack([np.bincount(group, values[:, k], minlength=groups) for k in range(values.shape[1])], 1)

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a sorted table, and whether the wanted values are there."""
        if not len(table):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def _bits(self, gram: np.ndarray) -> np.ndarray:
        """Lengths of the last bytes of four-byte strings; equal strings are looked up once."""
        gram, back = np.unique(gram, return_inverse=True)
        out, todo = np.zeros((len(gram), len(self.langs))), np.arange(len(gram))
        for d in range(DEPTH, -1, -1):
            at, hit = self._find(self.key[d], gram[todo] & ((1 << 8 * (d + 1)) - 1))
            out[todo[hit]] += self.cost[d][at[hit]]
            todo = todo[~hit]
            at, hit = self._find(self.context[d], (gram[todo] & ((1 << 8 * (d + 1)) - 1)) >> 8)
            out[todo[hit]] += self.escape[d][at[hit]]
        return out[back]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code lengths in bits, a row for each text and a column for each language. Long texts are added up in windows."""
        out = np.zeros((len(texts), len(self.langs)))
        for lo, hi in chunks(texts, 1 << 18):
            data, at = utf8(texts.slice(lo, hi - lo))
            data, at = _padded(data, at)
            row = lo + np.repeat(np.arange(hi - lo), np.diff(at))
            real = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at)) >= DEPTH
            for begin in range(DEPTH, len(data), WINDOW):
                end = min(len(data), begin + WINDOW)
                x = data[begin - DEPTH : end].astype(np.int64)
                own = real[begin:end]
                gram, of = (x[3:] | x[2:-1] << 8 | x[1:-2] << 16 | x[:-3] << 24)[own], row[begin:end][own]
                if len(of):
                    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    out[of[first]] += np.add.reduceat(self._bits(gram), first, axis=0)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its posterior if all languages are as likely before."""
        bits = self.lengths(texts)
        best = bits.argmin(1)
        score = 1 / np.exp2(-(bits - bits[np.arange(len(bits)), best][:, None]).clip(0, 1000)).sum(1)
        return [self.langs[k] for k in best], score


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from documents (text, lang, doc_id) that are labelled and not held out; None if there are none.

    The sample holds about `sample_docs` different whole documents of each language, chosen by a hash of doc_id and text, so ids that
    are null or equal change nothing; a language of which the hash chooses none gives those with the least hash. A repeated
    row is learned from once. So what the driver gets, counts of four-byte strings, does not grow with the corpus. The sample is counted in as
    many tasks as its documents ask for: each task gives its own counts of the strings that are common to all, so in as many tasks as the
    session shuffles to, there would be more counts than strings by far.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    known = known.select("lang", "text", spread(F.col("doc_id"), F.col("text"), seed=1).alias("_order"))
    size = {r["lang"]: (r["n"], r["least"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min("_order").alias("least")).collect()}
    if not size:
        return None
    bound = F.create_map([F.lit(x) for k, (n, least) in size.items() for x in (k, max(sample_docs / n, least))])[F.col("lang")]
    tasks = sum(min(n, sample_docs) for n, _ in size.values()) // DOCS_A_TASK + 1
    sample = known.where(F.col("_order") <= bound).dropDuplicates(["lang", "_order"]).coalesce(tasks)
    rows = sample.select("text", "lang").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return None
    langs = sorted(rows["lang"].unique())
    own = [rows[rows["lang"] == x].sort_values("gram") for x in langs]
    return Model(langs, [x["gram"].to_numpy(np.int64) for x in own], [x["n"].to_numpy(np.float64) for x in own])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs` (doc_id, text); other columns are ignored.

    A null text, one without letters, and every text if there is no model, gives `und` with score 0. Ties
    go to the first language by name. Repeated rows stay; texts are read whole, very long ones in windows.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.when(letters, F.col("text")).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slim(batches):
            texts = strings(batch.column(2))
            lang, score = sent.value.predict(texts)
            none = batch.column(2).is_null()
            lang = pa.compute.if_else(none, "und", pa.array(lang, pa.string()))
            score = pa.compute.if_else(none, 0.0, pa.array(score, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lang, score], ["doc_id", "held_out", "lang_pred", "score"])

    kind = typed(docs.schema["doc_id"].dataType)
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
