"""Pieces of plain SQL for the queries' own SQL, written apart from the Spark functions."""

from __future__ import annotations


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(replace(lower(coalesce({x}, '')), '.', ''), 'éèêëàâäîïôöùûüç-_', 'eeeeaaaiioouuuc  '), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def brand(x: str) -> str:
    return f"(SELECT CASE q WHEN 'b m w' THEN 'bmw' WHEN 'mercedes benz' THEN 'mercedes' WHEN 'vw' THEN 'volkswagen' ELSE q END FROM (SELECT {norm(x)} AS q))"


def values(rows: list[tuple], names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v))

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") {names}"


def has(x: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, w.replace("'", "''")) for w in words) + ")"


def dbl(text: str) -> str:
    """Decimal literals as doubles."""
    import re

    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1::DOUBLE", text)


def indel(pairs: str) -> str:
    """WITH RECURSIVE parts up to `f(a, b, ratio)`: the indel ratio of the different pairs (a, b), one character of b a step.

    `v` holds a bit for each character of a; those that are cleared count the longest common subsequence. Up to 60 characters.
    """
    mask = "list_sum(list_transform(range(length(a)), lambda j: CASE WHEN a[j + 1] = b[i + 1] THEN 1::BIGINT << j::INT ELSE 0::BIGINT END))::BIGINT"
    return f"""p AS (SELECT DISTINCT a, b FROM ({pairs})),
r AS (SELECT a, b, 0 AS i, (1::BIGINT << length(a)::INT) - 1 AS ones, (1::BIGINT << length(a)::INT) - 1 AS v FROM p
 UNION ALL SELECT a, b, i + 1, ones, ((v + h) | (v - h)) & ones FROM (SELECT *, v & coalesce({mask}, 0) AS h FROM r WHERE i < length(b))),
f AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * (length(a) - bit_count(v)) / (length(a) + length(b)) END AS ratio FROM r WHERE i = length(b))"""


def token_sets(pairs: str) -> str:
    """WITH RECURSIVE parts up to `token_sets(m, other, indel, token_set)` of the different pairs (m, other)."""
    words = lambda x: rf"list_sort(list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')))"
    less = lambda a, b: f"array_to_string(list_filter({a}, lambda w: NOT list_contains({b}, w)), ' ')"
    # shared words, and each side's rest after them
    sets = f"SELECT *, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS shared, {less('x', 'y')} AS mine, {less('y', 'x')} AS theirs FROM (SELECT DISTINCT m, other, {words('m')} AS x, {words('other')} AS y FROM ({pairs}))"
    sides = f"(SELECT m, other, shared, mine, theirs, trim(shared || ' ' || mine) AS l, trim(shared || ' ' || theirs) AS r FROM ({sets}))"
    compared = f"SELECT m AS a, other AS b FROM {sides} UNION ALL SELECT l, r FROM {sides} UNION ALL SELECT shared, l FROM {sides} UNION ALL SELECT shared, r FROM {sides}"
    best = "CASE WHEN shared <> '' AND (mine = '' OR theirs = '') THEN 100.0::DOUBLE WHEN shared <> '' THEN greatest(lr.ratio, bl.ratio, br.ratio) ELSE lr.ratio END"
    return f"""{indel(compared)},
token_sets AS (SELECT s.m, s.other, i.ratio AS indel, {best} AS token_set FROM {sides} s JOIN f i ON i.a = s.m AND i.b = s.other JOIN f lr ON lr.a = l AND lr.b = r JOIN f bl ON bl.a = shared AND bl.b = l JOIN f br ON br.a = shared AND br.b = r)"""
