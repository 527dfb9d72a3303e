"""Personal data: fixed base patterns, and candidates chosen by boosted trees.

Generators propose spans freely (digit groups, phone and card shapes, things with `@` or a spelled "at", account
numbers, long mixed tokens, values assigned to secrets' names), which may overlap. Boosted trees score each from its
format and context. They learn from what the base patterns would miss: valid base spans are rewritten (spelled
addresses, dotted phone numbers, oddly grouped cards, account numbers) beside lookalikes. Thresholds are calibrated on
values set apart; of the proposals above, the best that overlap neither each other nor a base span are added.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autolot.llm.boost import Boosted
from autolot.llm.common import chunks, ddl, slim, spread, strings, table, typed, utf8

#: Documents, as expected, and most proposals that the trees learn from.
SAMPLE_DOCS, SAMPLE_SPANS = 6000, 40_000
#: Share of right ones that is asked of proposals above a threshold.
PRECISION = 0.97
#: A generator adds nothing until so many proposals set apart were right above its threshold.
SURE = 5
BASE = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns, written so that no text costs more than a few steps a character: a match that starts inside a
# run of digits would also start at its beginning, and no run is given up once it has been read.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, without those that fail the kind's test; by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


#: Generators: their patterns propose freely, and their proposals may overlap. Each costs a few steps a character.
_PROPOSE = (
    ("number", re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+")),
    ("number", re.compile(r"(?<![0-9A-Za-z])\+?(?:[0-9]{1,3}[\x20.\-/])?\(?[0-9]{2,4}\)?[\x20.\-/][0-9]{3,4}[\x20.\-/]?[0-9]{3,4}(?![0-9])")),
    ("number", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._\-/]{1,3}[0-9]{4}){3}(?![0-9])")),
    ("contact", re.compile(r"(?<![^\s<>(),;:\"'])[^\s@<>(),;:\"']++@[^\s@<>(),;:\"']++")),
    ("contact", re.compile(r"(?<![\w.+-])[\w.+-]++\s?[\[({]\s?(?:at|@)\s?[\])}]\s?[\w-]++(?:(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\.)[\w-]++)+", re.I)),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")),
    ("secret", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++){2}(?![A-Za-z0-9_-])")),
    ("secret", re.compile(r"(?i:pass(?:word|wd)?|pwd|token|secret|api_?key)\s{0,4}[=:]\s{0,4}[\"']?([^\s\"',;<>]{6,}+)")),
)
ADDED = ("number", "contact", "account", "secret")
_MARK = re.compile(r"[0-9@]")
_WORDS = (
    re.compile(r"pass|pwd|token|secret|key|auth|credential", re.I),
    re.compile(r"tel|phone|call|mobile|fax|ssn|iban|account|card|mail|contact", re.I),
    re.compile(r"version|licen[sc]e|isbn|page|year|section|commit|sha|v\.", re.I),
)
_ASSIGNED = re.compile(r"(?:pass(?:word|wd)?|pwd|token|secret|api_?key)\s{0,4}[=:]\s{0,4}[\"']?\Z", re.I)
_KNOWN = re.compile(r"AKIA[0-9A-Z]{16}|(?:sk|pk|rk)-(?:[a-z]+-)?[A-Za-z0-9]{20,}|gh[opsu]_[A-Za-z0-9]{36,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_CALL = re.compile(r"(?:\+|00)?[0-9]{0,3}[\x20.\-/]?\(?[0-9]{3}\)?[\x20.\-/][0-9]{3}[\x20.\-/][0-9]{4}")
_DATE = re.compile(r"(?:[12][0-9]{3}[.\-/][0-9]{1,2}[.\-/][0-9]{1,2}|[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][12][0-9]{3})(?:\x20.*)?")
_NAME = re.compile(r"[\w.+-]+\Z")
FEATURES = (
    "length", "digits", "letters", "upper", "separators", "plus", "at", "dots", "hex", "kinds", "luhn", "spaces", "switches", "groups", "longest", "shortest", "mod97", "call", "date", "spelled", "domain",
    "assigned", "secret_word", "contact_word", "plain_word", "follows", "followed", *ADDED,
)


def iban(value: str) -> bool:
    """Whether the check digits of an account number hold (ISO 7064, mod 97)."""
    compact = value.replace(" ", "")
    return 15 <= len(compact) <= 34 and compact.isalnum() and compact.isascii() and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _features(text: str, kind: str, a: int, b: int) -> list[float]:
    s, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 8]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    switches = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    d, groups = _digits(s), [len(g) for g in re.findall("[0-9]+", s)] or [0]
    host = re.split(r"@|[\[({]\s?(?:at|@)\s?[\])}]", s, maxsplit=1)[-1] if kind == "contact" else ""
    return [
        b - a, digits, letters, sum(c.isupper() for c in s), len(s) - digits - letters, s[:1] == "+", "@" in s, s.count("."), all(c in "0123456789abcdef" for c in s), len(set(s)), 12 <= len(d) <= 19 and luhn(d), s.count(" "),
        switches, len(groups), max(groups), min(groups), kind == "account" and iban(s), bool(_CALL.fullmatch(s)), bool(_DATE.fullmatch(s)), bool(re.search(r"[\[({]", s)), bool(re.search(r"(?:\.|dot\s?[\])}]\s?)[A-Za-z]{2,}\Z", host)),
        bool(_ASSIGNED.search(before)), *(bool(w.search(before)) for w in _WORDS), bool(re.search(r"[0-9]\W?\Z", before)), bool(re.match(r"\W?[0-9]", after)), *(kind == k for k in ADDED),
    ]


def propose(text: str) -> list[Span]:
    """All proposals, of whole values of any length; they may overlap. Long words without a digit are none, unless they are assigned to a secret's name."""
    out = dict.fromkeys((kind, *m.span(m.lastindex or 0)) for kind, pattern in _PROPOSE for m in pattern.finditer(text) if kind != "secret" or m.lastindex or _MARK.search(text, *m.span()))
    return list(out)


def _overlap(a: int, b: int, spans: list[Span]) -> float:
    """The largest share that a span has in common with one of `spans`, of both together."""
    return max((max(0, min(b, y) - max(a, x)) / (max(b, y) - min(a, x)) for _, x, y in spans), default=0.0)


def _sure(text: str, span: Span) -> bool:
    """Weak label of a proposal that touches no base span, by its format and context: a key of known form, a value with a
    digit that is assigned to a secret's name, a full international phone number, or an account number whose check holds."""
    kind, a, b = span
    s = text[a:b]
    if kind == "secret":
        return bool(_KNOWN.fullmatch(s)) or bool(_MARK.search(s) and _ASSIGNED.search(text[max(0, a - 24) : a]))
    return (kind == "number" and s.startswith("+") and bool(_CALL.fullmatch(s))) or (kind == "account" and iban(s))


def altered(text: str, span: Span) -> list[tuple[str, str, bool]]:
    """Made-up examples from a base span or a secret: (words before, value, whether it is personal data).

    Right ones are its value in a form that the base patterns miss; wrong ones have the same look and another meaning.
    """
    kind, a, b = span
    s, d = text[a:b], _digits(text[a:b])
    rng = random.Random(zlib.crc32(f"{kind}:{s}".encode()))
    other = "".join(rng.choice("0123456789") for _ in range(20))
    if kind == "email":
        name, host = s.rsplit("@", 1)
        left, right = rng.choice(("[]", "()", "{}"))
        spelled = host.replace(".", f" {left}dot{right} ")
        yes = [("", f"{name} {left}at{right} {spelled}"), ("mail ", f"{name}{left}at{right}{host}"), ("contact: ", f"{name} {left}@{right} {host}"), ("", f"{name}@{host.rsplit('.', 1)[0].replace('.', '')}_x.{host.rsplit('.', 1)[1]}")]
        no = [("", f"@{name}"), ("", f"{name}@{rng.randint(1, 99)}"), ("", f"{name[:9]} {left}at{right} {rng.randint(1, 12)}.{rng.randint(10, 59)}"), ("page ", f"{name}@v{rng.randint(1, 9)}")]
    elif kind == "phone":
        d = d[-10:].rjust(10, "5")
        sep = rng.choice(".-/ ")
        yes = [("", f"({d[:3]}) {d[3:6]}-{d[6:]}"), ("phone ", sep.join((d[:3], d[3:6], d[6:]))), ("call ", f"00 1 {d[:3]} {d[3:6]} {d[6:]}"), ("", f"1-{d[:3]}-{d[3:6]}-{d[6:]}"), ("tel. ", f"({d[:3]}){sep}{d[3:6]}{sep}{d[6:]}")]
        no = [("", f"{1990 + int(d[0])}-0{1 + int(d[1]) % 9}-{10 + int(d[2])} {d[3:5]}"), ("isbn ", f"978-{d[0]}-{d[1:5]}-{d[5:9]}-{d[9]}"), ("", other[:10].replace("0", "1")), ("version ", ".".join((d[:2], d[2:4], d[4:8]))), ("", f"{d[:2]}/{d[2:4]}/{d[4:8]}")]
    elif kind == "card":
        wrong = d[:-1] + str((int(d[-1]) + 1 + rng.randrange(9)) % 10)
        cut = lambda v, sep: sep.join(v[k : k + 4] for k in range(0, len(v), 4))
        check = 98 - int(d[:18].ljust(18, "1") + "131400") % 97
        account = f"DE{check:02d}{d[:18].ljust(18, '1')}"
        yes = [("", cut(d, ".")), ("card ", cut(d, " - ")), ("", cut(d, "/")), ("", cut(d, "  ")), ("iban ", account), ("", " ".join(account[k : k + 4] for k in range(0, len(account), 4)))]
        no = [("", cut(wrong, ".")), ("card ", cut(wrong, " - ")), ("", wrong), ("", cut(wrong, "/")), ("", cut(wrong, "  ")), ("", f"DE{(check + 5) % 90 + 8:02d}{account[4:]}")]
    elif kind == "ip":
        yes, no = [], [("version ", f"{other[:4]}.{other[4:6]}.{other[6:9]}"), ("", f"{other[:3]}.{other[3:6]}"), ("section ", f"{other[0]}.{other[1]}.{other[2]}.{other[3:7]}.{other[8]}")]
    else:
        name = rng.choice(("password", "api_key", "secret", "pwd"))
        short = s[: rng.randint(8, 15)]
        yes = [(f"{name}={rng.choice(('', chr(34)))}", s), (f"{name}: ", short + "7"), ("", "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)))]
        code = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
        whole = [("", f"sk-{code(rng.randint(20, 48))}"), ("", f"ghp_{code(36)}"), ("bearer ", f"eyJ{code(rng.randint(12, 30))}.eyJ{code(rng.randint(20, 60))}.{code(rng.randint(20, 43))}")]
        yes += whole
        no = [("commit ", s), ("sha ", s), ("", "-".join((*re.findall("[a-z]+", s)[:4], "of", "the", "thing", other[:2]))), ("", "org.example.module_" + other[:2] + ".part"), ("", f"example{other[:2]}.tests.test_{other[:3]}"), ("", f"sk-{'-'.join(re.findall('[a-z]+', s)[:3])}-page-{other[:1]}")]
    return [(*x, True) for x in yes] + [(*x, False) for x in no]


def labelled(text: str) -> list[tuple[list[float], bool, int]]:
    """Examples (features, whether right, value's hash) of proposals in the text and in altered copies of its base spans and secrets.

    An altered value stands between the 40 characters before and after it. A proposal with most of a right one's span is
    right. Proposals that touch base spans can never be added and are no examples.
    """
    out: list[tuple[list[float], bool, int]] = []
    base = base_spans(text)
    source = list(base)
    for span in propose(text):
        if not any(a < span[2] and span[1] < b for _, a, b in base):
            yes = _sure(text, span)
            out.append((_features(text, *span), yes, zlib.crc32(text[span[1] : span[2]].encode())))
            if yes and span[0] == "secret":
                source.append(span)
    for span in source:
        kind, a, b = span
        cut = _ASSIGNED.search(text[max(0, a - 24) : a])
        before = text[max(0, a - 40) : a - (len(cut[0]) if cut else 0)]
        group = zlib.crc32(text[a:b].encode())
        for lead, value, right in altered(text, span):
            made = before + lead + value + text[b : b + 40]
            at = len(before) + len(lead)
            spans = base_spans(made)
            for got in propose(made):
                shared = _overlap(got[1], got[2], [("", at, at + len(value))])
                if shared > 0 and not any(x < got[2] and got[1] < y for _, x, y in spans):
                    out.append((_features(made, *got), right and shared >= 0.8, group))
    return out


#: Bytes without which nothing is found: digits, `@`, and signs before spelled addresses and assigned values.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*range(48, 58), *b"@[({=:"]] = True


def _suspect(texts: pa.Array) -> np.ndarray:
    """Rows with a byte of _SUSPECT."""
    out = []
    for lo, hi in chunks(texts):
        data, at = utf8(texts.slice(lo, hi - lo))
        total = np.append(0, np.cumsum(_SUSPECT[data]))
        out.append(total[at[1:]] > total[at[:-1]])
    return np.concatenate(out) if out else np.zeros(0, bool)


def _examples(batches):
    for batch in slim(batches):
        texts = strings(batch.column(0))
        found = [x for k in np.flatnonzero(_suspect(texts)).tolist() for x in labelled(texts[k].as_py())]
        if found:
            rows = np.array([x[0] for x in found], float)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(len(FEATURES))), pa.array([x[1] for x in found]), pa.array([x[2] for x in found], pa.int64())], [*FEATURES, "yes", "value"])


def outermost(spans: list[Span], some: list[int]) -> list[int]:
    """Those of the spans numbered `some` that lie in no longer one of them."""
    out, end, begin = [], -1, -1
    for k in sorted(some, key=lambda k: (spans[k][1], -spans[k][2])):
        _, a, b = spans[k]
        if b > end or (a, b) == (begin, end):
            out.append(k)
            begin, end = a, b
    return out


class Chooser:
    """Boosted trees with a threshold for each generator's kind; adds nothing where it has learned nothing.

    Two thirds of the values grow the trees, the others calibrate the thresholds, each halfway between the least score
    that is precise enough and the next lower one. All examples of one value, from
    whatever copy of a document, stand on one side.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, value: np.ndarray):
        self.model, self.least = None, dict.fromkeys(ADDED, np.inf)
        apart = value % 3 == 2
        if not len(y) or y[~apart].all() or not y[~apart].any():
            return
        self.model = Boosted().fit(x[~apart], y[~apart].astype(float))
        p, right = self.model.predict(x[apart]), y[apart]
        for k, name in enumerate(ADDED):
            own = x[apart, len(FEATURES) - len(ADDED) + k] > 0
            order = np.argsort(-p[own], kind="stable")
            s, good = p[own][order], np.cumsum(right[own][order])
            ok = np.flatnonzero((good >= PRECISION * np.arange(1, len(s) + 1)) & (s >= 0.5) & np.append(s[1:] < s[:-1], True))
            if len(ok) and good[ok[-1]] >= SURE:
                below = s[ok[-1] + 1] if ok[-1] + 1 < len(s) else 0.0
                self.least[name] = max(0.5, float(s[ok[-1]] + below) / 2)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and added ones: of the proposals that pass their kind's threshold, and lie in no longer one that does, from the
        best score on those that overlap neither a base span nor a better one."""
        base = base_spans(text)
        found = propose(text) if self.model is not None else []
        if not found:
            return base, []
        score = self.model.predict(np.array([_features(text, *s) for s in found], float))
        covered = bytearray(len(text))
        for _, a, b in base:
            covered[a:b] = b"\1" * (b - a)
        added: list[Span] = []
        passed = [k for k in range(len(found)) if score[k] >= self.least[found[k][0]] and covered.find(1, *found[k][1:]) < 0]
        for k in sorted(outermost(found, passed), key=lambda k: (-score[k], found[k][1] - found[k][2], found[k][1])):
            kind, a, b = found[k]
            if covered.find(1, a, b) < 0:
                covered[a:b] = b"\1" * (b - a)
                added.append((kind, a, b))
        return base, added


def joined(spans: list[Span]) -> str:
    order = {k: n for n, k in enumerate((*BASE, *ADDED))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))


def examples(docs: DataFrame) -> DataFrame:
    """The examples of all rows of `docs` (text): FEATURES, yes, and value, a hash of the value that they come from."""
    return docs.select("text").mapInArrow(_examples, ", ".join(f"`{k}` double" for k in FEATURES) + ", yes boolean, value long")


def chooser(rows: pd.DataFrame) -> Chooser:
    return Chooser(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["yes"].to_numpy(bool), rows["value"].to_numpy(np.int64))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> Chooser:
    """Learn from about `sample_docs` different whole documents, chosen by a hash of doc_id and text (so null or equal ids change nothing),
    and at most `sample_spans` of their examples. A repeated row is learned from once."""
    rows = docs.select("text", spread(F.col("doc_id"), F.col("text"), seed=2).alias("_at"))
    size = rows.agg(F.count("*").alias("n"), F.min("_at").alias("least")).first()
    rows = examples(rows.where(F.col("_at") <= max(sample_docs / max(1, size["n"]), size["least"] or 0.0)).dropDuplicates(["_at"]))
    return chooser(rows.withColumn("_order", F.xxhash64("value", *FEATURES)).orderBy("_order", "value", *FEATURES, "yes").limit(sample_spans).drop("_order").toPandas())


def find(docs: DataFrame, chooser: Chooser) -> DataFrame:
    """Spans of every row of `docs` (doc_id, text).

    Beside the base counts, their digest and all spans: n_added and its parts by kind, and n_spans, base and added
    together. A null text is empty; texts are read whole; repeated rows stay; other columns are ignored.
    """
    kind = typed(docs.schema["doc_id"].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(chooser)
    nothing = hashlib.sha256(b"").hexdigest()
    names = ["doc_id", *(f"n_{b}" for b in BASE), "base_sha256", "spans", "n_added", *(f"n_{k}" for k in ADDED), "n_spans"]

    def run(batches):
        for batch in slim(batches):
            texts = strings(batch.column(1))
            n, counts = len(texts), {k: np.zeros(len(texts), np.int64) for k in (*BASE, *ADDED)}
            sha, spans = [nothing] * n, [""] * n
            for k in np.flatnonzero(_suspect(texts)).tolist():
                base, added = sent.value.spans(texts[k].as_py())
                for s in base + added:
                    counts[s[0]][k] += 1
                if base:
                    sha[k] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[k] = joined(base + added)
            added = sum(counts[k] for k in ADDED)
            columns = [*(counts[k] for k in BASE), pa.array(sha, pa.string()), pa.array(spans, pa.string()), added, *(counts[k] for k in ADDED), added + sum(counts[k] for k in BASE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in names[1:]))


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, chooser: Chooser) -> DataFrame:
    """All rows and columns of `docs`, with spans in `text` replaced and `n_chars`, if there is one, counted anew. Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(chooser)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slim(batches):
            column = batch.column(at)
            texts = strings(column)
            found = column.to_pylist()
            for k in np.flatnonzero(_suspect(texts)).tolist():
                base, added = sent.value.spans(found[k])
                if base or added:
                    found[k] = redact_text(found[k], base + added)
            columns = list(batch.columns)
            columns[at] = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, ddl(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
