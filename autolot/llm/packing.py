"""Packing of tokenized documents into sequences of at most `capacity` tokens, by best-fit decreasing.

A document longer than a sequence is first cut into full windows; what is left of it, or a shorter
document, is one piece. Pieces are dealt at random to bins of work of about BIN_TOKENS tokens. In each, they
are taken from the longest on, and go to the open window whose remaining capacity is the least that
suffices; a segment tree over remaining capacities finds it.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autolot.llm.common import chunks, ddl, materialize, slim, strings, table, typed, utf8
from autolot.llm.words import spans

CAPACITY, END = 2048, 1
#: Tokens in pieces shorter than a window that are packed together, as expected: few enough for many tasks, and
#: so many that the last windows of a bin, the only ones that stay open, are about a thousandth of its windows.
BIN_TOKENS = 1_000_000
#: Full windows numbered together, as expected.
NUMBERED = 100_000
#: Spelled words that a worker remembers, about.
REMEMBERED = 500_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Classes of bytes in plain texts: ASCII without the apostrophe, and the letters U+00C0-U+00FF.
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_CLASS[ord("'")] = _ODD  # it can start a contraction
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Tokenizer:
    """Ids of whole texts, equal to the tokenizer's own.

    This vocabulary's tokens never reach over a word's end, where words are runs of letters, single
    digits, or runs of other characters but white space. So each different word is spelled once, by the
    tokenizer's merge model, and found again by a 64-bit hash. That is done for plain texts (see _CLASS);
    any other text is encoded by the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Model

        self.model = Model.from_file(path)
        self.merges = self.model.model
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE writes other bytes as 256, 257, ...
        others = iter(range(256, 512))
        self.letters = {k: chr(k) if k in printed else chr(next(others)) for k in range(256)}
        self._clear()

    def _clear(self) -> None:
        """Words by hash in an open table: `slots` holds hashes (0: free), `number` the words' numbers."""
        size = 4 * REMEMBERED
        self.mask = np.uint64((1 << (size - 1).bit_length()) - 1)
        self.slots = np.zeros(int(self.mask) + 1, np.uint64)
        self.number = np.zeros(len(self.slots), np.int32)
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.spelled, self.spelled_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or where there is none, of the first free slot after its place."""
        at = h & self.mask
        todo = np.flatnonzero((self.slots[at] != h) & (self.slots[at] != 0))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            got = self.slots[at[todo]]
            todo = todo[(got != h[todo]) & (got != 0)]
        return at

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        spelled = [[t.id for t in self.merges.tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(self.letters))] for w in words]
        n = np.array([len(x) for x in spelled], np.int64)
        base = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(spelled), np.uint32, int(n.sum()))])
        self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(words), np.uint8)])
        self.spelled_at = np.concatenate([self.spelled_at, self.spelled_at[-1] + np.cumsum([len(w) for w in words], dtype=np.int64)])
        todo = np.arange(len(h))
        while len(todo):  # of several hashes that meet in a free slot, one gets it
            at = self._find(h[todo])
            self.slots[at] = h[todo]
            won = self.slots[at] == h[todo]
            self.number[at[won]] = base + todo[won]
            todo = todo[~won]

    def _other(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Words whose bytes differ from those of the spelled word that was found for them."""
        size = end - start
        other = size != self.spelled_at[word + 1] - self.spelled_at[word]
        same = np.flatnonzero(~other)
        n = size[same]
        at = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(at, n)
        unlike = data[np.repeat(start[same], n) + step] != self.spelled[np.repeat(self.spelled_at[word[same]], n) + step]
        if unlike.any():
            other[same[np.searchsorted(at, np.flatnonzero(unlike), "right") - 1]] = True
        return other

    def _plain(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of plain texts, each text's offset in them, and the texts that hold a word with another one's hash."""
        data = _LOWER[data]
        upper = (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[:-1] == 0xC3)
        data[1:][upper] += 32
        kind = _CLASS[data]
        begin = np.ones(len(data), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begin[at[:-1][at[:-1] < len(data)]] = True
        edge = np.append(np.flatnonzero(begin), len(data))
        real = kind[edge[:-1]] != _SPACE
        start, end = edge[:-1][real], edge[1:][real]
        h = spans(data, start, end)
        h[h == 0] = 1
        if len(self.starts) > REMEMBERED:
            self._clear()
        where = self._find(h)
        new = np.flatnonzero(self.slots[where] == 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            raw = data.tobytes()
            self._learn(fresh, [raw[a:b] for a, b in zip(start[new[first]].tolist(), end[new[first]].tolist(), strict=True)])
            where = self._find(h)
        word = self.number[where]
        n = self.lengths[word]
        to = np.append(0, np.cumsum(n))
        step = np.arange(to[-1]) - np.repeat(to[:-1], n)
        clash = np.zeros(len(at) - 1, bool)
        clash[np.searchsorted(at, start[self._other(data, start, end, word)], "right") - 1] = True
        return self.ids[np.repeat(self.starts[word], n) + step], to[np.searchsorted(start, at)], clash

    def encode(self, texts: pa.Array):
        """The ids of each text of a null-free array, in order."""
        for lo, hi in chunks(texts):
            part = texts.slice(lo, hi - lo)
            data, at = utf8(part)
            odd = _CLASS[data] == _ODD
            lead = np.flatnonzero(data[:-1] == 0xC3)
            odd[lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]] = True  # multiplication and division signs
            odd[:-2] |= (data[:-2] == 0x3C) & (data[1:-1] == 0x7C)  # the start of a special token
            total = np.append(0, np.cumsum(odd))
            plain = total[at[1:]] == total[at[:-1]]
            ids, to, clash = self._plain(*utf8(part.filter(pa.array(plain))))
            k = -1
            for row, ok in enumerate(plain.tolist()):
                k += ok
                if ok and not clash[k]:
                    yield ids[to[k] : to[k + 1]]
                else:
                    yield np.array(self.model.encode(part[row].as_py(), add_special_tokens=False).ids, np.uint32)


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row of `docs` (doc_id, text): full windows, then the rest. A null text is empty; its one id is END."""
    kind = typed(docs.schema["doc_id"].dataType)

    def run(batches):
        tokenizer = Tokenizer(path)
        for batch in slim(batches):
            row, start, length, crc, tokens, ids = [], [], [], [], [], []
            for k, own in enumerate(tokenizer.encode(strings(batch.column(1)))):
                own = np.append(own, np.uint32(END)).astype("<u4")
                for at in range(0, len(own), capacity):
                    piece = own[at : at + capacity]
                    row.append(k)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    tokens.append(len(own))
                    if keep_ids:
                        ids.append(piece.astype(np.int64))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECE}" + ", ids array<long>" * keep_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its window, numbered from 0, and its offset there.

    The segment tree has a leaf for each remaining capacity; a node says whether any window below it is
    open. The tightest window is the first open leaf at or after the piece's length.
    """
    size = 1
    while size <= capacity:
        size *= 2
    open_ = [0] * (2 * size)  # windows below each node
    at_leaf: list[list[int]] = [[] for _ in range(capacity + 1)]
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        node = n + size
        if not open_[node]:
            while node > 1 and (node & 1 or not open_[node + 1]):
                node >>= 1  # up until a right sibling holds an open window
            if node > 1:
                node += 1
                while node < size:
                    node = 2 * node if open_[2 * node] else 2 * node + 1
        if node > 1:
            rest = node - size
            chosen = at_leaf[rest].pop()
            while node:
                open_[node] -= 1
                node >>= 1
        else:
            rest, chosen = capacity, made
            made += 1
        window[k], offset[k] = chosen, capacity - rest
        if rest > n:
            at_leaf[rest - n].append(chosen)
            node = rest - n + size
            while node:
                open_[node] += 1
                node >>= 1
    return window, offset


def pack(found: DataFrame, capacity: int = CAPACITY, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...).

    `found` is read twice and should be a written table. Full windows are sequences by themselves, and
    are not gathered, only numbered. The other pieces are dealt to as many bins as their tokens ask for, so no bin
    grows with the input, and only the last few windows of a bin stay open. Equal pieces are packed like others: rows are
    dealt by a hash of the piece and of the row's number in the written table, so that many equal ones go to many bins.
    Sequence numbers are unique, not gapless: odd for full windows. Columns that are called sequence_id, offset or _bin give way.
    """
    found = found.drop("sequence_id", "offset", "_bin")
    size = found.agg(F.sum(F.when(F.col("length") < capacity, F.col("length"))).alias("tokens"), F.count(F.when(F.col("length") == capacity, 1)).alias("full")).first()
    bins, groups = int((size["tokens"] or 0) // bin_tokens) + 1, int(size["full"] // NUMBERED) + 1

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "doc_id", "start"], ascending=False, kind="stable")
        window, offset = best_fit_decreasing(frame["length"].to_numpy(), capacity)
        return frame.drop(columns="_bin").assign(sequence_id=2 * (window * bins + int(key[0])), offset=offset)

    def dealt(rows: DataFrame, count: int) -> DataFrame:
        number = F.monotonically_increasing_id()
        return rows.withColumn("_bin", F.pmod(F.xxhash64("ids_crc32", "doc_id", "start", number), F.lit(count)).cast("int"))

    packed = dealt(found.where(F.col("length") < capacity), bins).groupBy("_bin").applyInPandas(run, f"{ddl(found)}, sequence_id long, offset long")
    number = F.row_number().over(Window.partitionBy("_bin").orderBy("ids_crc32", "doc_id", "start"))
    full = dealt(found.where(F.col("length") == capacity), groups).withColumn("sequence_id", 2 * (number * groups + F.col("_bin")) + 1)
    return packed.unionByName(full.drop("_bin").withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize all rows of `docs` (doc_id, text) and pack them; a row for each piece. Empty tables give no rows."""
    return pack(materialize(pieces(docs, path or vocabulary(), capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
