"""Column functions that normalise text and read structure out of it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from autolot.functions import refdata as R

# Letters with accents and those without.
ACCENTED, PLAIN = "éèêëàâäîïôöùûüç", "eeeeaaaiioouuuc"


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """The value of a constant table; `default` (null) where the key is not in it."""
    found = F.create_map([F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, default)


def bound(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_case(text: Column) -> Column:
    """Upper case at each word's start, where any character but a letter ends a word."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, F.initcap), "")


def normalize(text: Column) -> Column:
    """Lower case without accents and signs, single blanks; null gives the empty text."""
    s = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED + "-_.", PLAIN + "  ")
    return collapse(F.regexp_replace(s, r"[^a-z0-9\s]", ""))


def normalize_brand(text: Column) -> Column:
    n = normalize(text)
    return lookup(R.BRAND_ALIASES, n, n)


# Models at the beginning of a trade name, digits with letters or a word.
MODEL_PATTERNS = (r"^([A-Z]?\d{1,4}[A-Z]?)\b", r"^([A-Z][A-Z\-]+)\b")


def model_of_designation(designation: Column, brand: Column) -> Column:
    """The model in a trade name: digits with letters, else a word, else the first word without brackets."""
    d, b = F.upper(F.trim(F.coalesce(designation, F.lit("")))), F.upper(F.coalesce(brand, F.lit("")))
    d = F.when((b != "") & F.startswith(d, b), F.trim(F.substr(d, F.length(b) + 1))).otherwise(d)
    pick = lambda p: F.nullif(F.regexp_extract(d, p, 1), F.lit(""))
    first = F.regexp_replace(F.split(d, " ")[0], r"^[()]+|[()]+$", "")
    return F.lower(F.coalesce(*map(pick, MODEL_PATTERNS), first))


def model_key(brand: Column, model: Column) -> Column:
    return F.concat_ws("_", normalize_brand(brand), normalize(model))


def listing_text(title: Column, description: Column | None = None) -> Column:
    """A listing's text for extraction: lower case, no accents, signs as blanks, points kept. Null is empty."""
    s = F.coalesce(title, F.lit(""))
    s = s if description is None else F.concat_ws(" ", s, F.coalesce(description, F.lit("")))
    s = F.translate(F.lower(s), ACCENTED + "áíóúñãõåýÿšž", PLAIN + "aiounaoayysz")
    s = F.regexp_replace(F.regexp_replace(s, r"[/\-_,;:()\[\]]+", " "), r"\s+", " ")
    return F.trim(F.regexp_replace(s, r"[^\w\s.]", " "))


def has_word(low: Column, words: list[str], before: str = r"\b", after: str = r"\b") -> Column:
    """Whether a text in lower case holds one of the words between the boundaries. The pattern is tried only where a word stands at all."""
    return contains_any(low, words) & low.rlike(before + "(" + "|".join(map(re.escape, words)) + ")" + after)


def brand_in(text: Column) -> Column:
    """The first known brand of which an alias occurs as a word."""
    return bound(F.lower(text), lambda low: F.coalesce(*[F.when(has_word(low, [x.lower() for x in a]), F.lit(b.title())) for b, a in R.BRANDS.items()]))


def model_in(title: Column, brand: Column) -> Column:
    """The word after the brand in the raw title, upper case; a model of digits counts."""
    out = []
    for b, aliases in R.BRANDS.items():
        words = [bound(F.regexp_extract(title, r"(?i)\b" + re.escape(a) + r"\s+([a-zA-Z0-9\-]+)", 1), lambda w: F.when(F.length(w) >= 2, F.upper(w))) for a in aliases]
        out.append(F.when(brand == b.title(), F.coalesce(*words)))
    return F.coalesce(*out)


def most_frequent(values: Column) -> Column:
    """The most frequent element of an array, the first seen of equals; null if empty."""
    start = F.struct(F.lit(None).cast("int").alias("v"), F.lit(0).alias("n"))

    def step(best: Column, v: Column) -> Column:
        n = F.size(F.filter(values, lambda x: x == v))
        return F.when(n > best["n"], F.struct(v.alias("v"), n.alias("n"))).otherwise(best)

    return F.aggregate(F.array_distinct(values), start, step)["v"]


def power_candidates(text: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in R.POWER_PATTERNS])
    return F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x.between(50, 800))


def power_in(text: Column) -> Column:
    return bound(power_candidates(text), most_frequent)


def year_in(text: Column, last: int = 2026) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(R.YEAR_PATTERN), 1), lambda x: x.cast("int"))
    return F.get(F.filter(found, lambda x: x.between(2000, last)), F.lit(0))


def _hits(text: Column, words: list[str]) -> Column:
    """Occurrences of the words; no word stands inside another with its own boundaries, so one pattern counts all."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"), 0))


def gearbox_in(text: Column) -> Column:
    a, m = (_hits(text, R.GEARBOX_WORDS[k]) for k in ("automatique", "manuelle"))
    return F.when(a > m, "automatique").when(m > a, "manuelle").otherwise("inconnu")


def fuel_in(text: Column, normalize_keywords: bool = False) -> Column:
    """The first fuel, by priority, with a word in the text; `normalize_keywords` also finds accented and hyphened words."""
    def of(low: Column) -> Column:
        out = F
        for fuel, words in R.FUEL_WORDS.items():
            words = [w.replace("é", "e").replace("-", " ") for w in words] if normalize_keywords else words
            out = out.when(has_word(low, [w.lower() for w in words], r"(^|\s|-)", r"(\s|$|-)"), fuel)
        return out.otherwise("inconnu")

    return bound(F.lower(text), of)


def features(title: Column, description: Column | None = None) -> Column:
    """power, year, gearbox, fuel, text (200 characters), complete."""

    def complete(p: Column) -> Column:
        known = p["power"].isNotNull() & p["year"].isNotNull() & (p["gearbox"] != "inconnu") & (p["fuel"] != "inconnu")
        return F.struct(*[p[c].alias(c) for c in ("power", "year", "gearbox", "fuel", "text")], known.alias("complete"))

    def read(t: Column) -> Column:
        return bound(F.struct(power_in(t).alias("power"), year_in(t).alias("year"), gearbox_in(t).alias("gearbox"), fuel_in(t).alias("fuel"), F.substring(t, 1, 200).alias("text")), complete)

    return bound(listing_text(title, description), read)


# Sequences that stand for wrongly decoded letters.
MOJIBAKE = {"Ã©": "é", "Ã¨": "è", "Ãª": "ê", "Ã ": "à", "Ã¢": "â", "Ã§": "ç", "Ã´": "ô", "Ã®": "î", "Ã»": "û", "â‚¬": "€", "Â": ""}


def repair(text: Column) -> Column:
    return reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), MOJIBAKE.items(), text)


def digits(text: Column) -> Column:
    """All digits as one number; null without digits or beyond int."""
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("int")


def year_of(text: Column) -> Column:
    return F.regexp_extract(text, r"((19|20)\d{2})", 1).try_cast("int")


def rating(text: Column) -> Column:
    """A rating out of 10: `x/y` scaled, else a bare number up to 5 doubled, up to 10 as is, up to 20 halved."""
    num = lambda p, k: F.replace(F.regexp_extract(text, p, k), F.lit(","), F.lit(".")).try_cast("double")
    frac = r"(\d+(?:[.,]\d+)?)\s*/\s*(\d+)"
    x, y, v = num(frac, 1), num(frac, 2), num(r"(\d+(?:[.,]\d+)?)", 1)
    bare = F.when(v <= 5, F.round(v * 2, 1)).when(v <= 10, F.round(v, 1)).when(v <= 20, F.round(v / 2, 1))
    return F.when(x.isNotNull(), F.round(F.try_divide(x, y) * 10, 1)).otherwise(bare)


def suffixed_number(text: Column) -> Column:
    """`82.1K` and `1.2M` as numbers; 0 without a number."""
    pattern = r"(\d+(?:[.,]\d+)?)\s*([KM])?"
    t = F.upper(F.trim(text))
    v = F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(t, pattern, 2)
    return F.coalesce(F.round(v * F.when(unit == "K", 1000).when(unit == "M", 1000000).otherwise(1), 6).cast("long"), F.lit(0).cast("long"))


def pseudonym(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.when(n == "", "anonymous").otherwise(F.substring(F.sha2(n, 256), 1, 16))


def fault_class(text: Column) -> Column:
    t, out = F.lower(text), F
    for name, words in R.FAULT_CLASSES:
        out = out.when(contains_any(t, words), name)
    return out.otherwise("autre")


def recall_severity(risks: Column, motive: Column) -> Column:
    t = F.lower(F.concat_ws(" ", F.coalesce(risks, F.lit("")), F.coalesce(motive, F.lit(""))))
    return F.when(contains_any(t, R.RECALL_CRITICAL), "critical").when(contains_any(t, R.RECALL_SERIOUS), "serious").otherwise("moderate")
