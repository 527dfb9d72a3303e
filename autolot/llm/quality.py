"""Quality rules: statistics of whole texts, and a decision list learned from labelled documents.

The list rejects documents. Sequential covering grows one rule at a time, a conjunction of thresholds on
statistics, from labelled documents of low quality not yet covered, prunes it on labelled documents set
apart, and keeps it if it is precise enough. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autolot.llm.common import chunks, quoted, slim, spread, strings, table, typed, utf8
from autolot.llm.words import Words

#: Labelled documents sampled for learning, as expected; all are taken where there are fewer.
SAMPLE_LABELS = 4000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words")
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_STARTS = (np.arange(256) & 0xC0) != 0x80  # the first byte of a character
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_WHITE = " \t\n\v\f\r"


def _sums(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _twice(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which keys occur more than once in their row."""
    mark = key ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(mark)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(again, mark), len(again) - 1)
    return again[at] == mark


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a null-free array.

    Windows and lines that may be repeated are found by hash, then compared in full.
    """
    parts = []
    for lo, hi in chunks(texts):
        part = texts.slice(lo, hi - lo)
        data, at = utf8(part)
        w = Words(data, at)
        n = np.diff(w.first)
        out = dict.fromkeys(COUNTS)
        out["n_words"] = n
        out["word_chars"] = _sums(_STARTS[data] & ~w.separator, at)
        out["n_symbols"] = _sums(_SYMBOL[data], at)
        out["n_upper"] = _sums(_UPPER[data], at)
        rows = np.repeat(np.arange(hi - lo), n)
        raw = data.tobytes()

        marked = np.zeros(len(w.hash) + 1, np.int64)  # words in windows found twice
        first, hashes = w.windows(WINDOW)
        for k in np.flatnonzero(_twice(hashes, rows[first])).tolist() if len(first) else ():
            marked[first[k]] = 1
        for row in np.unique(rows[np.flatnonzero(marked)]).tolist():
            own = np.flatnonzero(marked[w.first[row] : w.first[row + 1]]) + w.first[row]
            text = [raw[a:b] for a, b in zip(w.start[w.first[row] : w.first[row + 1]].tolist(), w.end[w.first[row] : w.first[row + 1]].tolist(), strict=True)]
            seen: dict[tuple, int] = {}
            keys = [tuple(text[k - w.first[row] : k - w.first[row] + WINDOW]) for k in own.tolist()]
            for key in keys:
                seen[key] = seen.get(key, 0) + 1
            for k, key in zip(own.tolist(), keys, strict=True):
                marked[k] = seen[key] > 1
        cover = np.zeros(len(w.hash) + 1, np.int64)
        begin = np.flatnonzero(marked)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + WINDOW, -1)
        out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, w.first) if len(w.hash) else np.zeros(hi - lo, np.int64)

        # different words: one for each word hash and row
        key = w.hash ^ (rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(key), bool)
        fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
        out["n_distinct_words"] = _sums(fresh, w.first)

        dup, lines = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        ends = at.tolist()
        for k in range(hi - lo):
            known: set[bytes] = set()
            for line in raw[ends[k] : ends[k + 1]].split(b"\n"):
                if line.strip(b" \t\n\v\f\r"):
                    lines[k] += 1
                    if line in known:
                        dup[k] += 1
                    else:
                        known.add(line)
        out["n_dup_lines"], out["n_lines"] = dup, lines
        parts.append(out)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COUNTS}


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of COUNTS for every row, beside the columns `keep`; a null text has no words."""

    def run(batches):
        for batch in slim(batches):
            found = statistics(strings(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(found[k], pa.int64()) for k in COUNTS)], [*keep, *COUNTS])

    kinds = "".join(f"{quoted(k)} {typed(docs.schema[k].dataType)}, " for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, kinds + ", ".join(f"{k} long" for k in COUNTS))


def ratios() -> dict[str, Column]:
    """The statistics that rules speak of; all are defined for texts without words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "upper_share": F.col("n_upper") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct_words") / words,
        "word_length": F.col("word_chars") / words,
    }


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, sign, bound in rule:
        out &= x[name] > bound if sign == ">" else x[name] <= bound
    return out


def _precision(rule: Rule, x, bad: np.ndarray, alive: np.ndarray) -> tuple[float, int]:
    hit = _covers(rule, x, len(bad)) & alive
    n, p = int(hit.sum()), int((hit & bad).sum())
    return (p + 0.5) / (n + 1), p


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_terms: int = 3, precision: float = 0.97, least: int = 5) -> list[Rule]:
    """An ordered list of rules for rejecting; empty where nothing precise enough is found.

    Two thirds of the rows grow rules, one third prunes and admits them. A term is chosen by information
    gain over the rule so far (as in FOIL).
    """
    n = len(bad)
    grow = np.arange(n) % 3 != 2
    left = np.ones(n, bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        rule: Rule = []
        alive = left & grow
        if (alive & bad).sum() < least:
            break
        for _ in range(most_terms):
            now = _covers(rule, x, n) & alive
            p0, n0 = (now & bad).sum(), now.sum()
            if p0 == n0:
                break
            best = (0.0, None)
            for name in x:
                values = x[name][now]
                order = np.argsort(values, kind="stable")
                v, b = values[order], bad[now][order]
                cut = np.flatnonzero(v[1:] > v[:-1])
                low_p, low_n = np.cumsum(b)[cut], cut + 1
                for sign, p, m in (("<=", low_p, low_n), (">", p0 - low_p, n0 - low_n)):
                    gain = np.where(p > 0, p * (np.log2((p + 1e-9) / m) - np.log2(p0 / n0)), 0)
                    if len(gain) and gain.max() > best[0] + 1e-12:
                        k = cut[gain.argmax()]
                        best = (float(gain.max()), (name, sign, float((v[k] + v[k + 1]) / 2)))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        rest = left & ~grow
        while len(rule) > 1 and _precision(rule[:-1], x, bad, rest)[0] >= _precision(rule, x, bad, rest)[0]:
            rule.pop()
        hit, apart = _covers(rule, x, n) & left, _covers(rule, x, n) & rest
        if (apart & bad).sum() < max(1, least // 3) or (apart & bad).sum() < precision * apart.sum():  # on the pruning third alone
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_labels: int = SAMPLE_LABELS) -> list[Rule]:
    """Learn a decision list from about `sample_labels` labelled documents, chosen by a hash of doc_id.

    Of several texts under one labelled doc_id that with the least hash is learned from, so what the driver takes is bounded.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample_labels / max(1, known.count()))
    chosen = F.broadcast(known.where(spread(F.col("doc_id"), seed=4) < share))  # about sample_labels rows
    sample = docs.where(spread(F.col("doc_id"), seed=4) < share).select("doc_id", "text").join(chosen, "doc_id")
    rows = measure(sample, "doc_id", "quality").where("not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*COUNTS).alias("_h"), "quality", *COUNTS)).alias("_r")).select("doc_id", "_r.quality", *[f"_r.{c}" for c in COUNTS])
    frame = rows.select(F.xxhash64("doc_id").alias("_order"), "quality", *(v.alias(k) for k, v in ratios().items())).toPandas()
    frame = frame.sort_values(["_order", *ratios()])
    return learn({k: frame[k].to_numpy(float) for k in ratios()}, frame["quality"].to_numpy() == 0) if len(frame) else []


def verdict(rules: list[Rule]) -> Column:
    """Null for kept rows, else the number of the first rule that rejects."""
    names = ratios()
    out = F
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for name, sign, bound in rule:
            test &= names[name] > bound if sign == ">" else names[name] <= bound
        out = out.when(test, F.lit(k))
    return out.otherwise(F.lit(None)).cast("int") if rules else F.lit(None).cast("int")


def judge(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add base_failed, kept and failed_rule to measured rows."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("failed_rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. Repeated rows stay; other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(measure(docs, "doc_id"), rules).select("doc_id", *COUNTS, "base_failed", "kept", "failed_rule")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with all their columns, whatever these are called."""
    rules = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "text")

    def run(batches):
        for batch in slim(batches):
            found = statistics(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], pa.int64()) for k in COUNTS)], ["row", *COUNTS])

    return judge(rows.mapInArrow(run, f"row {typed(rows.schema['row'].dataType)}, " + ", ".join(f"{k} long" for k in COUNTS)), rules).where("kept").select("row.*")
