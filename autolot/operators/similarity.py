"""Similarity of names: indel and token-set ratios of whole batches of pairs, and joins on them without all pairs."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from autolot.sources.files import materialize, small

#: Pairs that are worked on at once, for names of up to 64 characters; fewer for longer ones.
AT_ONCE = 32_768


class Names:
    """The different names of two columns: their characters one after another, where each begins, and each row's two names (-1: null)."""

    def __init__(self, a: list[str | None], b: list[str | None]):
        code, names = pd.factorize(np.array([*a, *b], object))
        self.left, self.right = code[: len(a)], code[len(a) :]
        self.chars = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        self.at = np.append(0, np.cumsum(self.size))
        self.letters, self.code = np.unique(self.chars, return_inverse=True)

    def shared(self, left: np.ndarray, right: np.ndarray, bins: int = 32) -> np.ndarray:
        """At most so many letters of each pair agree, by counts of letters in a few bins."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        counts = np.bincount(row * bins + self.code % bins, minlength=len(self.size) * bins).reshape(-1, bins).astype(np.int32)
        out = np.zeros(len(left), np.int64)
        for lo in range(0, len(left), AT_ONCE):
            out[lo : lo + AT_ONCE] = np.minimum(counts[left[lo : lo + AT_ONCE]], counts[right[lo : lo + AT_ONCE]]).sum(1)
        return out

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence of each pair of names.

        A column of the table is kept as bits of 64-bit words, one bit for each character of the shorter name, and all pairs of a
        batch take the step for their next character at once (Hyyrö's form, with carries between words). A name's bits by character
        are made once in a batch, however many pairs it is in.
        """
        out = np.zeros(len(left), np.int64)
        swap = self.size[left] > self.size[right]
        short, long = np.where(swap, right, left), np.where(swap, left, right)
        words = np.maximum(1, -(-self.size[short] // 64))
        order = np.lexsort((self.size[long], words))
        order = order[self.size[short][order] > 0]
        lo, sorted_ = 0, words[order]
        while lo < len(order):
            w = int(sorted_[lo])
            hi = min(lo + max(1, AT_ONCE // w), int(np.searchsorted(sorted_, w, "right")))
            out[order[lo:hi]] = self._batch(short[order[lo:hi]], long[order[lo:hi]], w)
            lo = hi
        return out

    def _batch(self, short: np.ndarray, long: np.ndarray, w: int) -> np.ndarray:
        names, pattern = np.unique(short, return_inverse=True)
        size = self.size[names]
        row = np.repeat(np.arange(len(names)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        letters, code = np.unique(self.code[self.at[names][row] + place], return_inverse=True)
        known = np.full(len(self.letters) + 1, len(letters), np.int32)  # the last letter stands for all that the shorter names don't have
        known[letters] = np.arange(len(letters), dtype=np.int32)
        bits = np.zeros((w, len(names) * (len(letters) + 1)), np.uint64)
        np.bitwise_or.at(bits, (place // 64, row * (len(letters) + 1) + code), np.uint64(1) << (place % 64).astype(np.uint64))

        others, text = np.unique(long, return_inverse=True)
        length = self.size[others]
        steps = np.full((int(length.max()), len(others)), len(letters), np.int32)
        row = np.repeat(np.arange(len(others)), length)
        column = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        steps[column, row] = known[self.code[self.at[others][row] + column]]

        ones, base = np.uint64(0xFFFFFFFFFFFFFFFF), pattern * (len(letters) + 1)
        state = [np.full(len(pattern), ones) for _ in range(w)]
        for step in steps:
            at, carry = base + step[text], None
            for k in range(w):
                v, m = state[k], bits[k].take(at)
                u = v & m
                total = v + u
                if w > 1:
                    full = total if carry is None else total + carry
                    carry = ((total < v) | (full < total)).astype(np.uint64)
                    total = full
                state[k] = total | (v ^ u)
        left = np.zeros(len(pattern), np.int64)
        for k in range(w):
            used = np.clip(size[pattern] - 64 * k, 0, 64).astype(np.uint64)
            mask = np.where(used == 64, ones, (np.uint64(1) << np.minimum(used, np.uint64(63))) - np.uint64(1))
            left += np.bitwise_count(~state[k] & mask)
        return left


def ratios(a: list[str | None], b: list[str | None], least: float = 0.0) -> np.ndarray:
    """100 * (1 - insertions and deletions / both lengths) of each pair: 100 of two empty names, nan if one is null.

    Ratios below `least` are nan too; where lengths or counts of letters tell, nothing more is computed.
    """
    names, out = Names(a, b), np.full(len(a), np.nan)
    at = np.flatnonzero((names.left >= 0) & (names.right >= 0))
    left, right = names.left[at], names.right[at]
    both = names.size[left] + names.size[right]
    if least > 0:
        for bound in (lambda x, y: np.minimum(names.size[x], names.size[y]), names.shared):
            open_ = (200 * bound(left, right) >= least * both) | (both == 0)
            at, left, right, both = at[open_], left[open_], right[open_], both[open_]
    found = np.where(both == 0, 100.0, 200.0 * names.common(left, right) / np.maximum(both, 1))
    out[at] = np.where(found >= least, found, np.nan)
    return out


def token_sets(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """The best indel ratio of shared words, and of shared words with each side's rest; 100 if one side's words are the other's too.

    Shared words come first on both sides, so they are part of the longest common subsequence: only the rests are compared.
    """
    words: dict[str, tuple[frozenset[str], str]] = {}
    for x in (*a, *b):
        if isinstance(x, str) and x not in words:
            found = frozenset(re.findall(r"\w+", x.lower()))
            words[x] = found, " ".join(sorted(found))
    out, at, size, mine, theirs = np.full(len(a), np.nan), [], [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if isinstance(x, str) and isinstance(y, str):
            (p, left), (q, right) = words[x], words[y]
            both = p & q
            if both:
                if len(both) == len(p) or len(both) == len(q):
                    out[i] = 100.0
                    continue
                left, right = " ".join(sorted(p - both)), " ".join(sorted(q - both))
            at.append(i)
            size.append(sum(map(len, both)) + len(both))  # with the blank after each
            mine.append(left)
            theirs.append(right)
    if at:
        names, shared = Names(mine, theirs), np.array(size)
        n, m = names.size[names.left], names.size[names.right]
        total = 2 * shared + n + m
        best = np.where(total == 0, 100.0, 200.0 * (shared + names.common(names.left, names.right)) / np.maximum(total, 1))
        for rest in (n, m):  # shared words alone, against them with a side's rest
            best = np.where(shared > 0, np.maximum(best, 200.0 * (shared - 1) / np.maximum(2 * shared - 1 + rest, 1)), best)
        out[at] = best
    return out


def _by_batch(f: Callable[[list, list], np.ndarray]) -> Callable[[Column | str, Column | str], Column]:
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(a.tolist(), b.tolist()))

    return run


indel_ratio = _by_batch(ratios)
token_set_ratio = _by_batch(token_sets)


def indel_at_least(least: float) -> Callable[[Column | str, Column | str], Column]:
    """The indel ratio of two columns, null below `least`."""
    return _by_batch(lambda a, b: ratios(a, b, least))


def lettered(names: DataFrame, block: str, name: str, least: float) -> DataFrame:
    """`names` (block, name, ...) with _letters, the occurrences of letters of the name, the rarest in the table first, and _prefix.

    Two names of lengths n and m with a ratio of at least `least` share least / 200 * (n + m) occurrences of letters. Of a name's
    occurrences in one order for all names, the first ones, _prefix, hold one of any such set, if their number is n less the
    fewest that it may share with any name, plus one. An empty name has one occurrence of its own, and meets empty names.
    """
    def occurrences(x: Column) -> Column:
        letters = F.split(x, "")
        return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda d: d == c)).cast("string")))

    each = names.select(block, name, F.explode(F.when(F.col(name) == "", F.array(F.lit(""))).otherwise(occurrences(F.col(name)))).alias("_o"))
    counts = each.groupBy("_o").agg(F.count("*").alias("_c"))  # as many rows as letters have occurrences in one name
    sorted_ = each.join(small(materialize(counts, "letters")), "_o").groupBy(block, name).agg(F.array_sort(F.collect_list(F.struct("_c", "_o"))).alias("_s"))
    n = F.length(name)
    shortest = F.ceil(n * least / (200 - least))
    keep = F.greatest(F.lit(1), n - F.ceil((n + shortest) * least / 200 - 1e-9) + 1).cast("int")
    out = sorted_.withColumn("_letters", F.transform("_s", lambda x: x["_o"])).withColumn("_prefix", F.slice("_letters", 1, keep)).drop("_s")
    return names.join(out, [block, name])


def met(left: DataFrame, right: DataFrame, least: float, block: str, a: str, right_block: str, b: str) -> DataFrame:
    """Pairs of a block whose names may be alike, each once, with the columns of both: their first letters by rarity share one, their lengths allow the
    ratio, and so do the letters that they share. Both sides come from `lettered`, the right one's lists as _l and _p."""
    x = left.withColumn("_key", F.explode("_prefix"))
    y = right.withColumn("_at", F.explode("_p"))
    n, m = F.length(a), F.length(b)
    pairs = x.join(y, (F.col(block) == F.col(right_block)) & (F.col("_key") == F.col("_at")) & (F.least(n, m) * 200 >= F.lit(least) * (n + m)))
    first = F.element_at(F.array_intersect("_prefix", "_p"), 1) == F.col("_key")
    enough = (F.size(F.array_intersect("_letters", "_l")) * 200 >= F.lit(least) * (n + m)) | ((n == 0) & (m == 0))
    return pairs.where(first & enough).drop("_key", "_at", "_prefix", "_p", "_letters", "_l")


#: Names of a block, by their hits, that are tried in the first rounds.
ROUNDS = (64, 256, 1024)


def first_similar(left: DataFrame, right: DataFrame, block: str, model: str, other: str, hit: str, least: float = 50.0, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """Different (block, model) of `left` with the least `hit` of those rows of `right` in the block whose `other` has an indel ratio of at least `least`.

    As only the first hit counts, names are tried in the order of hits: in each round the names that have none yet meet the next few names of their
    block. Those that are still without one meet all others by the letters that a similar name must share (`lettered`, `met`).
    So names that are like many find one soon, and names that are like few are compared with few. Null blocks and names match nothing.
    """
    asked = materialize(left.select(block, model).where(F.col(block).isNotNull() & F.col(model).isNotNull()).distinct(), "asked")
    known = right.where(F.col(block).isNotNull() & F.col(other).isNotNull())
    known = materialize(known.groupBy(F.col(block).alias("_b"), other).agg(F.min(hit).alias(hit)), "known")
    alike = indel_at_least(least)
    a, b = F.length(model), F.length(other)
    found, past = [], 0
    for size in rounds:
        order = Window.partitionBy("_b").orderBy(hit, other)
        some = materialize(known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).where(F.col("_n") > past).drop("_n"), "some")
        if past and some.isEmpty():  # no block has more names
            break
        pairs = asked.join(small(some), F.col(block) == F.col("_b")).where(F.least(a, b) * 200 >= F.lit(least) * (a + b))
        got = pairs.where(alike(F.col(model), F.col(other)).isNotNull()).groupBy(block, model).agg(F.min(hit).alias(hit))
        found.append(materialize(got, "found"))
        asked = materialize(asked.join(found[-1].select(block, model), [block, model], "left_anti"), "asked")
        past = size
        if asked.isEmpty():
            break
    else:
        more = known.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(hit, other))).where(F.col("_n") <= past).drop("_n")
        rest = known.join(small(materialize(more.select("_b", other), "past")), ["_b", other], "left_anti") if past else known
        found.append(similar(asked, rest, block, model, other, hit, least))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def similar(asked: DataFrame, known: DataFrame, block: str, model: str, other: str, hit: str, least: float) -> DataFrame:
    """The least `hit` of those names of `known` (_b, other, hit) that are like each of `asked` (block, model), by letters that both must have."""
    names = materialize(asked.select(F.col(block).alias("_tb"), F.col(model).alias("_t")).unionByName(known.select(F.col("_b").alias("_tb"), F.col(other).alias("_t"))).distinct(), "names")
    listed = materialize(lettered(names, "_tb", "_t", least), "letters")
    x = asked.join(listed, (F.col(block) == F.col("_tb")) & (F.col(model) == F.col("_t"))).drop("_tb", "_t")
    y = known.join(listed, (F.col("_b") == F.col("_tb")) & (F.col(other) == F.col("_t"))).select("_b", other, hit, F.col("_letters").alias("_l"), F.col("_prefix").alias("_p"))
    pairs = met(x, y, least, block, model, "_b", other)
    return pairs.where(indel_at_least(least)(F.col(model), F.col(other)).isNotNull()).groupBy(block, model).agg(F.min(hit).alias(hit))


def similar_pairs(left: DataFrame, right: DataFrame, block: str, a: str, right_block: str, b: str, least: float) -> DataFrame:
    """(block, a, b, ratio) of the different pairs of a block with an indel ratio of at least `least`. Only pairs that meet by letters that both
    must have are compared (`lettered`, `met`)."""
    x0 = left.select(F.col(block).alias("_tb"), F.col(a).alias("_t")).where("_tb is not null and _t is not null")
    y0 = right.select(F.col(right_block).alias("_tb"), F.col(b).alias("_t")).where("_tb is not null and _t is not null")
    listed = materialize(lettered(materialize(x0.unionByName(y0).distinct(), "names"), "_tb", "_t", least), "letters")
    x = x0.distinct().join(listed, ["_tb", "_t"]).select(F.col("_tb").alias(block), F.col("_t").alias(a), "_letters", "_prefix")
    y = y0.distinct().join(listed, ["_tb", "_t"]).select(F.col("_tb").alias("_b"), F.col("_t").alias(b), F.col("_letters").alias("_l"), F.col("_prefix").alias("_p"))
    return met(x, y, least, block, a, "_b", b).select(block, a, b, indel_at_least(least)(F.col(a), F.col(b)).alias("ratio")).where("ratio is not null")


def trigrams(name: Column) -> Column:
    """Different runs of three characters of a name in lower case with a blank at both ends."""
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


#: Digits to which cosines and norms are compared, so that sums in another order tie alike.
DIGITS = 9
#: Pairs of a name, in multiples of `top`, that its rarest trigrams may bring before bounds are known.
BUDGET = 4


def _together(wanted: DataFrame, grams: DataFrame, block: str, name: str, other: str) -> DataFrame:
    """Different pairs (block, name, other) that meet in one of the wanted trigrams (block, name, g) of the names."""
    return wanted.join(grams, (F.col(block) == F.col("_b")) & (F.col("g") == F.col("_g"))).select(block, name, other).distinct()


def cosine_top(left: DataFrame, right: DataFrame, block: str, name: str, right_block: str, other: str, top: int = 200) -> DataFrame:
    """(block, name, other, cosine): the `top` names of the block by TF-IDF cosine over trigrams (ties by name) for each different name of `left`.

    Only pairs that share a trigram meet; trigrams that `right` lacks do not count. A trigram weighs log((N + 1) / (names with it + 1)).
    Not all such pairs are scored. A name's rarest trigrams bring its first pairs. What all names of a block share (the brand's own
    trigrams) tells pairs apart by their norms alone, so of these the `top` least norms are enough. The worst of the `top` best cosines so far is
    then a threshold; what the trigrams not used yet can give at most, by their weights and by the least norm of a name that has them, is
    held against it, and only those that can still reach it bring more pairs. So the result is exact.
    """
    asked = left.select(block, name).where(F.col(block).isNotNull() & F.col(name).isNotNull()).distinct()
    known = right.select(F.col(right_block).alias("_b"), other).where(F.col("_b").isNotNull() & F.col(other).isNotNull()).distinct()
    grams = materialize(known.select("_b", other, F.explode(trigrams(F.col(other))).alias("_g")), "grams")
    names = known.select(other).distinct().count()
    weights = grams.select(other, "_g").distinct().groupBy("_g").agg(F.count("*").alias("_d")).select("_g", F.pow(F.log((F.lit(names) + 1) / (F.col("_d") + 1)), F.lit(2)).alias("_w"))
    weights = materialize(weights, "weights")
    weighted = materialize(grams.join(small(weights), "_g"), "weighted")
    norms = materialize(weighted.groupBy("_b", other).agg(F.sqrt(F.sum("_w")).alias("_norm"), F.collect_list("_g").alias("_grams")), "norms")  # the trigrams of one name
    sizes = norms.groupBy("_b").agg(F.count("*").alias("_names"))
    lists = weighted.join(norms.select("_b", other, "_norm"), ["_b", other]).groupBy("_b", "_g").agg(F.count("*").alias("_n"), F.min("_norm").alias("_least"))
    lists = materialize(lists.join(small(materialize(sizes, "sizes")), "_b").select(F.col("_b").alias("_lb"), F.col("_g").alias("_lg"), "_n", "_least", (F.col("_n") == F.col("_names")).alias("_all")), "lists")

    own = asked.select(block, name, F.explode(trigrams(F.col(name))).alias("g")).join(small(weights), F.col("g") == F.col("_g")).drop("_g")
    own = own.join(lists, (F.col(block) == F.col("_lb")) & (F.col("g") == F.col("_lg")), "left")
    each = Window.partitionBy(block, name)  # the trigrams of one name
    rare = each.orderBy(F.col("_all"), F.desc("_w"), "g")  # nulls: trigrams of other blocks; then those that not all have; then the shared ones
    after = rare.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = rare.rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(
        block, name, "g", "_w", F.coalesce("_all", F.lit(False)).alias("_all"), F.col("_n").isNotNull().alias("_here"),
        F.sqrt(F.sum("_w").over(each)).alias("_own"), F.sum(F.when(F.col("_n").isNotNull(), F.col("_w")).otherwise(0.0)).over(after).alias("_rest"),
        F.min(F.when(~F.col("_all"), F.col("_least"))).over(after).alias("_shortest"), F.coalesce(F.sum(F.when(~F.col("_all"), F.col("_n"))).over(before), F.lit(0)).alias("_met"),
    )
    own = materialize(own, "own")
    vectors = materialize(own.groupBy(block, name).agg(F.first("_own").alias("_own"), F.array_sort(F.collect_list(F.struct((-F.col("_w")).alias("o"), "g"))).alias("_v"), F.max("_all").alias("_any")), "vectors")

    def scored(pairs: DataFrame) -> DataFrame:
        full = pairs.join(small(vectors.drop("_any")), [block, name]).join(small(norms), (F.col(block) == F.col("_b")) & (pairs[other] == norms[other])).select(block, name, pairs[other].alias(other), "_own", "_v", "_norm", "_grams")
        dot = F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.when(F.array_contains("_grams", x["g"]), -x["o"]).otherwise(0.0))
        return full.select(block, name, other, F.round(F.coalesce(F.try_divide(dot, F.col("_norm") * F.col("_own")), F.lit(0.0)), DIGITS).alias("cosine"))

    open_ = F.col("_here") & ~F.col("_all")
    first = _together(own.where(open_ & (F.col("_met") < BUDGET * top)), grams, block, name, other)
    shortest = Window.partitionBy("_b").orderBy(F.round("_norm", DIGITS), other)
    champions = materialize(norms.withColumn("_k", F.row_number().over(shortest)).where(F.col("_k") <= top).select("_b", other), "champions")
    shared = vectors.where("_any").join(small(champions), F.col(block) == F.col("_b")).select(block, name, other)
    some = materialize(scored(materialize(first.unionByName(shared).distinct(), "pairs")), "scored")

    place = Window.partitionBy(block, name).orderBy(F.desc("cosine"), other)
    least = some.withColumn("_k", F.row_number().over(place)).where(F.col("_k") == top).select(block, name, F.col("cosine").alias("_bar"))
    bound = F.least(F.sqrt("_rest") / F.col("_own"), F.coalesce(F.col("_rest") / (F.col("_own") * F.col("_shortest")), F.lit(2.0)))
    later = own.where(open_ & (F.col("_met") >= BUDGET * top)).join(least, [block, name], "left").where(F.col("_bar").isNull() | F.coalesce(bound >= F.col("_bar") - 2 * 10.0**-DIGITS, F.lit(True)))
    more = _together(later, grams, block, name, other).join(some.select(block, name, other), [block, name, other], "left_anti")
    return some.unionByName(scored(materialize(more, "pairs"))).withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= top).drop("_k")


def two_stage(left: DataFrame, right: DataFrame, block: str, name: str, other: str, hit: str, top: int = 200, sure: float = 92.0, likely: float = 85.0) -> DataFrame:
    """Entity match: of the `top` names of the block by trigrams (`cosine_top`) the one with the best token-set ratio (ties: best cosine, least `hit`).

    `status` is auto, probable or reject. Names that share no trigram with any of their block have no row.
    """
    known = right.groupBy(F.col(block).alias("_b"), other).agg(F.min(hit).alias(hit))
    near = cosine_top(left, right, block, name, block, other, top)
    ranked = near.withColumn("ratio", token_set_ratio(F.col(name), F.col(other))).join(known, (F.col(block) == F.col("_b")) & (near[other] == known[other])).select(block, name, near[other].alias(other), hit, "ratio", "cosine")
    best = F.max_by(F.struct(other, hit, "ratio"), F.struct("ratio", "cosine", -F.col(hit)))
    return ranked.groupBy(block, name).agg(best.alias("_r")).select(block, name, "_r.*").withColumn("status", F.when(F.col("ratio") >= sure, "auto").when(F.col("ratio") >= likely, "probable").otherwise("reject"))
