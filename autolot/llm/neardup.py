"""Near-duplicates by DartMinHash signatures (Christiani), banded joining, and exact checks.

Darts are thrown at the elements of a weighted set. The axis of an element's weight is cut into strips ([0, 1), [1, 2),
[2, 4), ...); each strip is hit by a Poisson process over time, whose hits (darts) have hashed places and coordinates.
A set sees the darts that lie within its weights; the earliest one of each coordinate is its sample. Two sets agree
there with the probability of their weighted Jaccard similarity (sum of minima over sum of maxima). Only darts up to a
time that suffices for a set's total weight are made, so a signature of k samples costs about elements + k log k steps.

Texts that agree in a whole band of samples share a bucket. Each is compared exactly with its bucket's first text, the
one that meets most others in all its buckets, which the original of many copies does; a
bucket's texts that are not linked so are compared with each other, unless their distances from the first text rule
a link out (the distance, one less the similarity, is a metric).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autolot.llm.common import chunks, materialize, quoted, slim, strings, table, typed, utf8
from autolot.llm.graphs import components, maybe_broadcast
from autolot.llm.words import Words, mix

SHINGLE, SIMILAR, WEIGHTING = 5, 0.8, "count"
#: 24 bands of 6: a pair at 0.8 meets in a band with probability 0.9993, one at 0.33 with 0.03.
BANDS, ROWS = 24, 6
#: Bytes of texts in a block of work, and most texts in a block that are compared with each other.
BLOCK_BYTES, BLOCK = 4_000_000, 128
_ODD1, _ODD2, _ODD3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of all shingles of n words; a text of fewer words is one shingle, one without words none."""
    w = Words(data, at)
    first, h = w.windows(n)
    row = np.searchsorted(w.first, first, "right") - 1
    count = np.diff(w.first)
    for k in np.flatnonzero((count > 0) & (count < n)).tolist():
        own = np.uint64(count[k])
        for x in w.hash[w.first[k] : w.first[k + 1]]:
            own = np.uint64((int(own) * int(_ODD2) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        row, h = np.append(row, k), np.append(h, own)
    return row, h


def elements(row: np.ndarray, h: np.ndarray, weighting: str = WEIGHTING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's different shingles with their weights, by row and hash. The weight is 1 (`set`), the number of
    occurrences n (`count`), or 1 + ln n (`log`)."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    count = np.diff(np.append(np.flatnonzero(fresh), len(h))).astype(float)
    return row[fresh], h[fresh], {"set": np.ones_like, "count": np.asarray, "log": lambda n: 1 + np.log(n)}[weighting](count)


def strips(row: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows, keys, lower ends, widths and elements' weights of all strips that the weights reach into."""
    found, low, n = [(row, element, np.zeros(len(row)), np.ones(len(row)), weight)], 1.0, 0
    while (more := weight > low).any():
        n += 1
        found.append((row[more], mix(element[more] + np.uint64(n) * _ODD3), np.full(more.sum(), low), np.full(more.sum(), low), weight[more]))
        low *= 2
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """k samples for each of `rows` weighted sets; sets without elements have zeros."""
    total = np.bincount(row, weight, minlength=rows)
    out = np.zeros((rows, k), np.uint64)
    until = k * (np.log(k) + 3) / np.where(total > 0, total, 1)
    todo = total > 0
    row, key, low, width, top = strips(row, element, weight)
    whole, unit = top >= low + width, width == 1
    whole, unit = None if whole.all() else whole, None if unit.all() else unit
    while todo.any():
        at = np.flatnonzero(todo[row])
        time, best = np.zeros(len(at)), np.full(rows * k, np.inf)
        cells, times, values = [], [], []
        n = 0
        while len(at):  # the n-th dart of each strip that is still within its set's time
            n += 1
            dart = mix(key[at] + np.uint64(n * int(_ODD1) & 0xFFFFFFFFFFFFFFFF))
            wait = np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)
            time = time - (wait if unit is None else wait / width[at])
            alive = time <= until[row[at]]
            at, time, dart = at[alive], time[alive], mix(dart[alive] ^ _ODD2)
            seen = slice(None)
            if whole is not None and len(part := np.flatnonzero(~whole[at])):  # darts in a strip that is only partly reached
                seen = np.ones(len(at), bool)
                seen[part] = low[at[part]] + width[at[part]] * ((dart[part] & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2**32 < top[at[part]]
            cells.append(row[at[seen]] * k + ((dart[seen] >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64))
            times.append(time[seen])
            values.append(dart[seen])
        cell, when, value = map(np.concatenate, (cells, times, values))
        np.minimum.at(best, cell, when)
        first = when == best[cell]
        flat = np.zeros(rows * k, np.uint64)
        flat[cell[first]] = value[first]
        done = todo & np.isfinite(best.reshape(rows, k)).all(1)
        out[done] = flat.reshape(rows, k)[done]
        todo &= ~done
        until *= 2
    return out


def bands(sample: np.ndarray, count: int, size: int) -> np.ndarray:
    """A hash for each band of each row."""
    part = sample.reshape(len(sample), count, size)
    h = np.arange(1, count + 1, dtype=np.uint64)[None] * _ODD3
    for k in range(size):
        h = mix(h * _ODD1 + part[:, :, k])
    return h


def signed(docs: DataFrame, weighting: str = WEIGHTING, count: int = BANDS, size: int = ROWS) -> DataFrame:
    """(doc_id, node, size, bands) of every row with a text; node is the text's MD5, size its bytes."""

    def run(batches):
        for batch in slim(batches):
            texts = strings(batch.column(3))
            for lo, hi in chunks(texts, 1 << 19):
                data, at = utf8(texts.slice(lo, hi - lo))
                row, h, w = elements(*shingles(data, at), weighting)
                some = np.bincount(row, minlength=hi - lo) > 0
                found = bands(signatures(row, h, w, hi - lo, count * size), count, size).view(np.int64)
                offsets = np.append(0, np.cumsum(np.where(some, count, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[some].ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(3)), lists], ["doc_id", "node", "size", "bands"])

    kind = typed(docs.schema["doc_id"].dataType)
    rows = docs.where("text is not null").select("doc_id", F.md5("text").alias("node"), F.octet_length("text").alias("size"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, node string, size int, bands array<long>")


class Sets:
    """The weighted shingles of texts, by number."""

    def __init__(self, texts: pd.Series, weighting: str):
        row, self.h, self.w = elements(*shingles(*utf8(strings(pa.array(texts, pa.string())))), weighting)
        self.at = np.searchsorted(row, np.arange(len(texts) + 1))
        self.total = np.bincount(row, self.w, minlength=len(texts))

    def similarity(self, a: int, b: int) -> float:
        """Weighted Jaccard similarity of two texts; 0 if one has no words. Equal 64-bit hashes count as equal shingles."""
        x, y = slice(*self.at[a : a + 2]), slice(*self.at[b : b + 2])
        at = np.minimum(np.searchsorted(self.h[y], self.h[x]), max(0, self.at[b + 1] - self.at[b] - 1))
        if not len(at) or not self.total[b]:
            return 0.0
        same = self.h[y][at] == self.h[x]
        shared = np.minimum(self.w[x][same], self.w[y][at[same]]).sum()
        return float(shared / (self.total[a] + self.total[b] - shared))


def _stars(frame: pd.DataFrame, weighting: str) -> pd.DataFrame:
    """The similarity of each text of the frame to the first text of its star."""
    frame = frame.drop_duplicates(["star", "node"]).reset_index(drop=True)
    sets = Sets(frame["text"], weighting)
    head = {x: k for k, (x, y) in enumerate(zip(frame["star"], frame["node"], strict=True)) if x == y}
    found = [(y, x, sets.similarity(k, head[x])) for k, (x, y) in enumerate(zip(frame["star"], frame["node"], strict=True)) if x != y]
    return pd.DataFrame(found, columns=["node", "first", "similarity"]).astype({"node": str, "first": str, "similarity": float})


def _rest(frame: pd.DataFrame, least: float, weighting: str) -> pd.DataFrame:
    """Links among texts of one bucket that are not connected yet. A pair is compared in its first common bucket only."""
    frame = frame.drop_duplicates(["band", "node"]).reset_index(drop=True)
    sets, found = Sets(frame["text"], weighting), []
    nodes, part = frame["node"].to_numpy(), frame["part"].to_numpy()
    for band, own in frame.groupby("band").indices.items():
        marks, near = np.stack(frame["bands"].to_numpy()[own]), frame["similarity"].to_numpy()[own]
        low, high = frame["low"].iloc[own[0]], frame["high"].iloc[own[0]]
        pair = np.triu(np.abs(near[:, None] - near[None]) <= 1 - least + 1e-9, 1)
        common = marks[:, None] == marks[None]
        pair &= np.take_along_axis(np.broadcast_to(marks[:, None], common.shape), common.argmax(2)[:, :, None], 2)[:, :, 0] == band
        alike = part[own][:, None] == part[own][None]  # pairs within a block are compared beside one other block only
        pair &= ~alike | (np.where(part[own] > 0, 0, min(1, high)) == np.where(part[own] == low, high, low))[:, None]
        root = {x: x for x in frame["root"].to_numpy()[own]}

        def top(x, root=root):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in zip(*(own[x] for x in np.nonzero(pair)), strict=True):
            x, y = top(frame["root"].iat[i]), top(frame["root"].iat[j])
            if x != y and sets.similarity(i, j) >= least - 1e-9:
                root[x] = y
                found.append((nodes[i], nodes[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype=str)


def _packed(groups: DataFrame, name: str, block_bytes: int) -> DataFrame:
    """Add `pack` to `groups` (with bytes, blocks): small groups share a number, so that a task's work is worth its start."""
    small = groups.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    return groups.withColumn("pack", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(name), F.lit(int(small // block_bytes) + 1))))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of `nodes` (node, doc_id), each once, written; the only join with all texts.

    Rows that repeat text and doc_id, as all copies without a doc_id do, bring a node's text several times; then each is kept once.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.md5("text").alias("_md5"), "text")
    texts = materialize(rows.join(maybe_broadcast(nodes), F.expr("_md5 = node and _id <=> doc_id")).select("node", "text"), "texts")
    return texts if texts.count() == nodes.count() else materialize(texts.dropDuplicates(["node"]), "texts")


def links(docs: DataFrame, rows: DataFrame, least: float = SIMILAR, weighting: str = WEIGHTING, block_bytes: int = BLOCK_BYTES, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among nodes that connect every pair of at least the similarity `least` that meets in a band.

    Every text is compared with the first text of each of its buckets. A frequent first text is sent once to each block
    of the texts that are compared with it, so the work and the copies of texts go with the number of such comparisons.
    What is left in a bucket is compared in blocks, two at a time; no task holds more than two blocks.
    """
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    member = nodes.select("node", "size", F.explode("bands").alias("band"))
    met = materialize(member.join(member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"), "met")
    known = met.groupBy("node").agg(F.sum("n").alias("score"))
    firsts = met.select("node", "band").join(known, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("_first")).select("band", F.col("_first.node").alias("first"))
    met = materialize(met.select("band", "node", "size").join(firsts, "band"), "met")
    texts = _texts(docs, materialize(nodes.join(known.select("node"), "node").select("node", "doc_id"), "candidates"))
    near = materialize(_similarities(texts, met, weighting, block_bytes), "near")
    linked = near.where(F.col("similarity") >= least - 1e-9).select(F.col("node").alias("a"), F.col("first").alias("b"))

    # Texts that are not linked to a bucket's first one, and linked ones that may be near enough to them.
    loose = near.where(F.col("similarity") < least - 1e-9)
    if loose.isEmpty():
        return linked
    close = materialize(met.join(maybe_broadcast(materialize(loose, "loose")), ["node", "first"]).groupBy("band").agg(F.max("similarity").alias("closest")), "close")
    rest = met.where("node <> first").join(maybe_broadcast(close), "band").join(near, ["node", "first"])
    rest = rest.where((F.col("similarity") < least - 1e-9) | (F.col("similarity") <= F.col("closest") + (1 - least) + 1e-9))
    rest = rest.join(maybe_broadcast(components(linked)), "node", "left").select("band", "node", "size", "similarity", F.coalesce("root", "node").alias("root"))
    rest = materialize(rest, "rest")
    mixed = rest.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = mixed.select("band", "bytes", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks"))
    mixed = _packed(materialize(mixed, "mixed"), "band", block_bytes)
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    wanted = rest.join(maybe_broadcast(materialize(mixed, "mixed")), "band").withColumn("part", own).join(nodes.select("node", "bands"), "node")
    texts = texts.join(maybe_broadcast(materialize(wanted, "wanted")), "node")
    other = F.explode(F.expr("if(blocks = 1, array(0), filter(sequence(0, blocks - 1), x -> x <> part))"))
    texts = texts.withColumn("other", other).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    key = F.when(F.col("blocks") == 1, F.col("pack").cast("string")).otherwise(F.concat_ws(":", "band", "low", "high"))
    texts = texts.select(key.alias("key"), "band", "part", "low", "high", "node", "root", "similarity", "bands", "text")
    return linked.unionByName(texts.groupBy("key").applyInPandas(lambda frame: _rest(frame, least, weighting), "a string, b string"))


def _similarities(texts: DataFrame, met: DataFrame, weighting: str, block_bytes: int) -> DataFrame:
    """(node, first, similarity) of each text and each different first text of its buckets."""
    edges = materialize(met.where("node <> first").groupBy("node", "first").agg(F.first("size").alias("size")), "edges")
    stars = edges.groupBy(F.col("first").alias("star")).agg(F.sum("size").alias("bytes")).withColumn("blocks", F.ceil(F.col("bytes") / block_bytes).cast("int"))
    stars = materialize(_packed(materialize(stars, "stars"), "star", block_bytes), "stars")
    spokes = edges.select("node", F.col("first").alias("star")).join(maybe_broadcast(stars), "star").withColumn("low", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    heads = stars.withColumns({"node": F.col("star"), "low": F.lit(0)})
    wanted = spokes.withColumn("high", F.col("low")).unionByName(heads.withColumn("high", F.col("blocks") - 1)).select("node", "star", "pack", "low", "high")
    texts = texts.join(maybe_broadcast(materialize(wanted, "spokes")), "node").withColumn("block", F.explode(F.sequence("low", "high")))
    key = F.coalesce(F.col("pack").cast("string"), F.concat_ws(":", "star", "block"))
    texts = texts.select(key.alias("key"), "star", "node", "text")
    return texts.groupBy("key").applyInPandas(lambda frame: _stars(frame, weighting), "node string, first string, similarity double")


def members(docs: DataFrame, least: float = SIMILAR, weighting: str = WEIGHTING) -> DataFrame:
    """(doc_id, node, root) of every row with a text; rows of one class have one root."""
    rows = materialize(signed(docs, weighting), "signed")
    roots = materialize(components(links(docs, rows, least, weighting)), "roots")
    return materialize(rows.select("doc_id", "node").join(maybe_broadcast(roots), "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")), "members")


def classes(docs: DataFrame, least: float = SIMILAR, weighting: str = WEIGHTING) -> DataFrame:
    """(doc_id, node, class_id) of every row of `docs` (doc_id, text).

    Equal texts, and texts linked directly or in steps, form a class; class_id is its least doc_id (null if it
    has none). A text without words equals its exact copies only. A row with a null text is in a class of its
    own (node null). Repeated rows stay. Empty tables give an empty result; other columns are ignored.
    """
    member = members(docs, least, weighting)
    least_id = materialize(member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").select("root", "class_id"), "classes")
    found = member.join(maybe_broadcast(least_id), "root", "left").select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"))
    return found.unionByName(docs.where("text is null").select("doc_id", F.lit(None).cast("string").alias("node"), F.col("doc_id").alias("class_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row of each class, with all columns: that with the least doc_id (null if it has none, and of several texts
    with this doc_id the least MD5), once if it is repeated. All rows with a null text. Classes, not ids, are counted:
    different texts stay, whether they share a doc_id or have none.
    """
    member = members(docs, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head")
    heads = materialize(member.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1").select("root", F.col("head.doc_id").alias("_doc"), F.col("head.node").alias("_node")), "heads")
    found = member.join(maybe_broadcast(heads), "root").select("doc_id", "node", F.expr("node = _node and doc_id <=> _doc").alias("kept"))
    dropped = materialize(found.where("not kept").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node")).distinct(), "dropped")
    again = materialize(found.where("kept").groupBy("node").agg(F.count("*").alias("_n")).where("_n > 1").select("node"), "again")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), "doc_id", F.md5("text").alias("node"))
    rows = rows.join(maybe_broadcast(dropped), F.expr("node = _node and doc_id <=> _doc"), "left_anti")
    if again.isEmpty():  # as where no row is repeated: the texts are joined once
        return rows.select("row.*")
    twice = rows.join(maybe_broadcast(again), "node", "left_semi").dropDuplicates(["node"])
    once = rows.join(maybe_broadcast(again), "node", "left_anti")
    return once.select("row").unionByName(twice.select("row")).select("row.*")
