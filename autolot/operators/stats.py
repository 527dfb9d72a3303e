"""Aggregates over reviews, recalls, prices and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autolot.functions import refdata as R
from autolot.functions import scores as S
from autolot.functions import text as T


def verified_means(reviews: DataFrame, keys: list[str], criteria: list[str], least: int = 3) -> DataFrame:
    """Means of criteria over reviews of high or medium confidence, of groups with at least `least` of them."""
    means = [F.round(F.avg(c), 1).alias(c) for c in criteria]
    return reviews.where(F.col("level").isin("high", "medium")).groupBy(*keys).agg(*means, F.count("*").alias("n")).where(F.col("n") >= least)


def recall_stats(recalls: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by severity, impact and score, with the penalty and the badge score."""
    severity = T.recall_severity(F.col("risks"), F.col("motive"))
    text = F.lower(F.concat_ws(" ", F.coalesce("motive", F.lit("")), F.coalesce("risks", F.lit(""))))
    df = recalls.withColumns({"_s": severity, "_p": T.contains_any(text, R.RECALL_PENALTY)})
    count = lambda v: F.count_if(F.col("_s") == v)
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), count("critical").alias("critical"), count("serious").alias("serious"), count("moderate").alias("moderate"), F.count_if("_p").alias("penal"))
    impact = F.col("critical") * 2.0 + F.col("serious") * 1.0 + F.col("moderate") * 0.5
    badge = S.clamp(10.0 - F.col("critical") * 2.0 - F.col("serious") * 1.0 - F.col("moderate") * 0.3)
    return out.withColumns({"impact": F.round(impact, 2), "score": F.round(F.greatest(F.lit(0.0), 10.0 - impact), 2), "badge_score": F.round(badge, 1), "penalty": S.recall_penalty(F.col("total"), F.col("penal"))})


def vehicle_stats(reviews: DataFrame, recalls: DataFrame, keys: list[str], spread: list[str], criteria: list[str], digits: int = 6) -> DataFrame:
    """Reviews of each vehicle: their number, mean and deviation of `spread`, means of `criteria`, and all its recalls (0: none)."""
    mean = lambda c: F.round(F.avg(c), digits).alias(c)
    deviations = [F.round(F.stddev_samp(c), digits).alias(f"{c}_sd") for c in spread]
    got = reviews.groupBy(*keys).agg(F.count("*").alias("n"), *map(mean, [*spread, *criteria]), *deviations)
    return got.join(recalls.groupBy(*keys).agg(F.count("*").alias("rappels")), keys, "left").fillna(0, ["rappels"])


def station_prices(feed: DataFrame) -> DataFrame:
    """Mean, least and highest price per litre of each fuel, and stations; default prices for fuels without any."""
    spark = feed.sparkSession
    names = F.create_map([F.lit(x) for fuel, ns in R.STATION_NAMES.items() for n in ns for x in (n, fuel)])
    price = F.col("raw").try_cast("double") / 1000
    known = feed.select(names[F.col("name")].alias("fuel"), price.alias("p")).where("fuel is not null and p is not null")
    got = known.groupBy("fuel").agg(F.round(F.avg("p"), 3).alias("mean"), F.round(F.min("p"), 3).alias("least"), F.round(F.max("p"), 3).alias("most"), F.count("*").alias("stations"))
    default = spark.createDataFrame(list(R.STATION_DEFAULTS.items()), "fuel string, usual double")
    return default.join(got, "fuel", "left").select("fuel", F.coalesce("mean", "usual").alias("mean"), "least", "most", F.coalesce("stations", F.lit(0)).alias("stations"))


def top_words(items: DataFrame, keys: list[str], word: str, most: int) -> DataFrame:
    """The most frequent words of each group, joined by `;` (ties by name). Counted before they are ranked."""
    from autolot.operators.rows import cap

    counts = items.groupBy(*keys, word).agg(F.count("*").alias("_n"))
    best = cap(counts, keys, [F.desc("_n"), word], most)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col(word).alias("w"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["w"]), ";").alias("top"))


def quality_of_sources(sources: Column) -> Column:
    """high: all scores verified; medium: half of them; none: no score; else low."""
    n, good = F.size(sources), F.size(F.filter(sources, lambda s: s.isin("official", "verified_scrape")))
    return F.when(n == 0, "none").when(good == n, "high").when(good >= n * 0.5, "medium").otherwise("low")


def regression_metrics(df: DataFrame, label: str, guess: str) -> DataFrame:
    """MSE, RMSE, MAE and R2."""
    e = F.col(label) - F.col(guess)
    sums = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(label).alias("v"))
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"))
