"""URL filter by empirical-Bayes host reputation, beside fixed allow and block rules.

Labelled page outcomes are counted by host, registered domain and public suffix. A suffix's rate is
shrunk to the overall rate, a domain's to its suffix's, a host's to its domain's: each level is the beta
prior of the next. The strength of each prior is not given but estimated from the counts of its level, by
the method of moments: the less the children differ beyond chance, the stronger it is. A host is blocked
if its posterior gives at least `sure` to good rates below the overall rate, which is to say that the
upper bound of its good rate at that level lies below the overall rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autolot.llm.common import materialize, table
from autolot.llm.graphs import maybe_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Posterior probability of a good rate below the overall one from which a host is blocked.
SURE = 0.9
#: Bounds of an estimated strength, in pages: children that differ no more than by chance get the upper one.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: Steps of the integral on each side of the cut.
STEPS = 200
#: Labels under which two-letter top-level domains register names, as in `co.uk`. Fixed values.
REGISTRY = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "sch")
SUFFIX = r"(?:(?:" + "|".join(REGISTRY) + r")\.[a-z][a-z]|[^.]*)$"
ADDRESS = r"^[0-9.]+$|^\["


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def keys(host: Column) -> tuple[Column, Column, Column]:
    """A host's reputation key, registered domain and public suffix. User names, ports and a last dot are cut off;
    an address is its own domain and suffix."""
    key = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::[0-9]*)?$", "")
    address = key.rlike(ADDRESS)
    suffix = F.when(address, key).otherwise(F.regexp_extract(F.concat(F.lit("."), key), r"\.(" + SUFFIX[:-1] + r")$", 1))
    domain = F.when(address, key).otherwise(F.regexp_extract(key, r"(?:[^.]+\.)?" + SUFFIX, 0))
    return key, domain, suffix


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def strength(children: DataFrame, parents: int) -> float:
    """Pages that a prior is worth, from its children (n, good, rate of the parent), by the method of moments.

    With strength m, the squared standardised deviations of the children's rates sum to about
    df + (sum of n - 1) / (m + 1).
    """
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("rate")))
    off = F.pow(F.col("good") - F.col("n") * rate, F.lit(2.0)) / (F.col("n") * rate * (1 - rate))
    row = children.where("n > 0").agg(F.sum(off).alias("off"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("more")).first()
    if not row["more"]:
        return STRONGEST
    extra = (row["off"] - (row["k"] - parents)) / row["more"]
    return STRONGEST if extra <= 0 else min(STRONGEST, max(WEAKEST, 1 / extra - 1))


def mass_below(a: Column, b: Column, cut: Column, steps: int = STEPS) -> Column:
    """The share of a beta distribution below `cut`, by the trapezoid rule in the logit of the rate, where its density is smooth."""
    peak, spread = F.log(a / b), 9 * F.sqrt(1 / a + 1 / b)
    left, right = peak - spread - 30 / a, peak + spread + 30 / b
    at = F.greatest(left, F.least(right, F.log(cut / (1 - cut))))
    top = a * F.log(a / (a + b)) + b * F.log(b / (a + b))

    def density(t: Column) -> Column:
        return F.exp(a * t - (a + b) * (F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))) - top)

    def area(lo: Column, hi: Column) -> Column:
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda s, k: s + density(lo + (hi - lo) * k / steps))
        return (hi - lo) / steps * (inner + (density(lo) + density(hi)) / 2)

    return area(left, at) / (area(left, at) + area(at, right))


def _shrunk(children: DataFrame, level: str, parents: int) -> DataFrame:
    """Rate of each child (n, good; rate and held of its parent), and `held`, the pages that its posterior is worth.

    The mean is shrunk by the level's strength. What the prior holds is less: its spread is that of the level
    and that of the parent's own posterior together.
    """
    own = F.lit(strength(children, parents))
    rate = (F.col("good") + own * F.col("rate")) / (F.col("n") + own)
    return children.select(level, rate.alias("rate"), (F.col("n") + 1 / (1 / own + 1 / F.col("held"))).alias("held"))


def reputations(known: DataFrame) -> DataFrame:
    """The posterior of each host of `known` (host, domain, suffix, n, good): host_rate, weight (the pages it is worth), and below, the probability of a good rate below the overall one.

    `known` is a written table with a row for each host. Without any outcome, no host has a posterior (nulls).
    """
    total = known.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    none = F.lit(None).cast("double")
    if not total["n"]:
        return known.select("host", none.alias("host_rate"), none.alias("weight"), none.alias("below"))
    overall = total["good"] / total["n"]
    counts = known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumns({"rate": F.lit(overall), "held": F.lit(float(total["n"]))})
    suffixes = _shrunk(materialize(counts, "suffixes"), "suffix", 1)
    counts = known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(suffixes, "suffix")
    domains = _shrunk(materialize(counts, "domains"), "domain", suffixes.count())
    hosts = _shrunk(materialize(known.select("host", "domain", "n", "good").join(domains, "domain"), "hosts"), "host", domains.count())
    rate = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("rate")))
    cut = F.lit(max(0.001, min(0.999, overall)))
    return hosts.select("host", F.col("rate").alias("host_rate"), F.col("held").alias("weight"), mass_below(F.col("held") * rate, F.col("held") * (1 - rate), cut).alias("below"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, sure: float = SURE) -> DataFrame:
    """Judge every page by rule, else by its host's posterior.

    `pages` has page_id and url; `outcomes` has page_id and good (0 or 1; null rows count for nothing; a
    page may have several). Null urls and urls without `://` have an empty host and path, which is a host
    like another. A host without outcomes stands as its domain, suffix, or the overall rate; without any
    outcome at all everything not blocked by rule is allowed (host_rate and below are null). Repeated pages
    stay, very long urls are taken whole, other columns are ignored, and empty tables give no rows. Counts are
    summed before the shuffle. The table of hosts is broadcast if it is written small enough; else Spark shuffles,
    and splits a frequent host.
    """
    urls = pages.select("page_id", F.col("url").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    key, domain, suffix = keys(F.col("host"))
    label = outcomes.where("good is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    known = urls.select("page_id", key.alias("host")).join(label, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = materialize(reputations(materialize(known.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good"), "known")), "reputations")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("below") >= sure, "block").otherwise("allow")
    found = urls.withColumn("_key", key).join(maybe_broadcast(hosts.withColumnRenamed("host", "_key")), "_key", "left")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), *(F.round(c, 6).alias(c) for c in ("host_rate", "weight", "below")))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page is good if the label of its document says quality 1 and toxic 0. The document's number is the last part of the page's path."""
    number = F.expr(r"try_cast(regexp_extract(_path, '/([0-9]+)(?:\\.[a-z]+)?/?$', 1) as bigint)")
    paged = pages.select("page_id", host_and_path(F.col("url"))[1].alias("_path")).select("page_id", number.alias("doc_id")).where("doc_id is not null").distinct()
    good = labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")).where("good is not null")
    return paged.join(good, "doc_id").select("page_id", "good")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, outcomes(pages, table(spark, sf_dir, "labels")))


_SUFFIX = SUFFIX[:-1]
_MASS = """(hi - lo) / 200 * (list_sum(list_transform(range(1, 200), lambda k: exp(a * (lo + (hi - lo) * k / 200) - (a + b) * (greatest(lo + (hi - lo) * k / 200, 0.0::DOUBLE)
  + ln(1 + exp(-abs(lo + (hi - lo) * k / 200)))) - top))) + (exp(a * lo - (a + b) * (greatest(lo, 0.0::DOUBLE) + ln(1 + exp(-abs(lo)))) - top) + exp(a * hi - (a + b) * (greatest(hi, 0.0::DOUBLE) + ln(1 + exp(-abs(hi)))) - top)) / 2)"""


def _strength(table_name: str, parents: str) -> str:
    """SQL of a level's strength."""
    return f"""(SELECT CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 10000.0::DOUBLE WHEN x <= 0 THEN 10000.0::DOUBLE ELSE least(10000.0::DOUBLE, greatest(2.0::DOUBLE, 1 / x - 1)) END
  FROM (SELECT n, (sum(pow(good - n * p, 2) / (n * p * (1 - p))) OVER () - (count(*) OVER () - ({parents}))) / nullif(sum(n - 1) OVER (), 0) AS x
        FROM (SELECT n, good, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, rate)) AS p FROM {table_name} WHERE n > 0)) GROUP BY x)"""


SQL = rf"""
WITH u0 AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u1 AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u0),
u AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS key,
             try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:\.[a-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM u1),
g AS (SELECT doc_id, ((quality = 1) AND (toxic = 0))::INT AS good FROM labels WHERE ((quality = 1) AND (toxic = 0)) IS NOT NULL),
l AS (SELECT page_id, count(*) AS n, sum(good) AS good FROM (SELECT DISTINCT page_id, doc_id FROM u) JOIN g USING (doc_id) GROUP BY page_id),
k AS (SELECT host, CASE WHEN ip THEN host ELSE regexp_extract('.' || host, '\.({_SUFFIX})$', 1) END AS suffix,
             CASE WHEN ip THEN host ELSE regexp_extract(host, '(?:[^.]+\.)?{_SUFFIX}$') END AS domain, n, good
      FROM (SELECT key AS host, regexp_matches(key, '{ADDRESS}') AS ip, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good FROM u LEFT JOIN l USING (page_id) GROUP BY key)),
t AS (SELECT sum(good) / nullif(sum(n), 0) AS r0, sum(n) AS n0 FROM k),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(r0) AS rate, any_value(n0) AS held FROM k, t GROUP BY suffix),
s AS (SELECT suffix, (good + m * rate) / (n + m) AS rate, n + 1 / (1 / m + 1 / held) AS held FROM s0, (SELECT {_strength("s0", "1")} AS m)),
d0 AS (SELECT domain, suffix, n, good, rate, held FROM (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM k GROUP BY domain, suffix) JOIN s USING (suffix)),
d AS (SELECT domain, (good + m * rate) / (n + m) AS rate, n + 1 / (1 / m + 1 / held) AS held FROM d0, (SELECT {_strength("d0", "SELECT count(*) FROM s")} AS m)),
h0 AS (SELECT host, n, good, rate, held FROM k JOIN d USING (domain)),
h1 AS (SELECT host, (good + m * rate) / (n + m) AS rate, n + 1 / (1 / m + 1 / held) AS held FROM h0, (SELECT {_strength("h0", "SELECT count(*) FROM d")} AS m)),
h AS (SELECT host, rate, held, held * greatest(0.001::DOUBLE, least(0.999::DOUBLE, rate)) AS a, held * (1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, rate))) AS b,
             greatest(0.001::DOUBLE, least(0.999::DOUBLE, r0)) AS cut FROM h1, t),
e AS (SELECT *, ln(a / b) - 9 * sqrt(1 / a + 1 / b) - 30 / a AS l, ln(a / b) + 9 * sqrt(1 / a + 1 / b) + 30 / b AS r, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS top FROM h),
f AS (SELECT *, greatest(l, least(r, ln(cut / (1 - cut)))) AS c FROM e),
q AS (SELECT host AS key, rate, held, (SELECT {_MASS} FROM (SELECT l AS lo, c AS hi)) AS low, (SELECT {_MASS} FROM (SELECT c AS lo, r AS hi)) AS high FROM f),
v AS (SELECT page_id, host, path, rate, held, low / (low + high) AS below,
  CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u LEFT JOIN q USING (key))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
       WHEN below >= 0.9 THEN 'block' ELSE 'allow' END AS verdict, round(rate, 6) AS host_rate, round(held, 6) AS weight, round(below, 6) AS below FROM v
"""
