"""Column functions that score vehicles, listings, reviews and sheets. Reference years are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from autolot.functions import refdata as R
from autolot.functions.text import contains_any, lookup



def clamp(x: Column, low: float = 0.0, high: float = 10.0) -> Column:
    """Into the range; null stays null, which least and greatest would pass over."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x.cast("double"))


def tidy(x: Column, digits: int) -> Column:
    """Round half up, after dropping what the last bits of a sum add to a tie."""
    return F.round(F.round(x, 9), digits)


def mean_of_known(*values: Column) -> Column:
    """The mean of those values that are not null; null without any."""
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(n > 0, total / n)


def weighted_mean(values: list[tuple[Column, float]]) -> Column:
    """The weighted mean of known values, weights renormalised; null without any."""
    w = sum((F.when(v.isNotNull(), F.lit(x)).otherwise(F.lit(0.0)) for v, x in values), F.lit(0.0))
    total = sum((F.coalesce(v * x, F.lit(0.0)) for v, x in values), F.lit(0.0))
    return F.when(w > 0, total / F.nullif(w, F.lit(0.0)))


def budget(consumption: Column, co2: Column, fuel: Column) -> Column:
    c, e, f = F.nullif(consumption, F.lit(0.0)), F.nullif(co2, F.lit(0.0)), F.lower(F.coalesce(fuel, F.lit("")))
    by_use = F.when(c < 4, 2.5).when(c < 5, 2.0).when(c < 6, 1.0).when(c < 7, 0.0).when(c < 9, -1.0).when(c.isNotNull(), -2.0).otherwise(0.0)
    by_co2 = F.when(e < 100, 1.5).when(e < 130, 0.5).when(e > 200, -1.0).otherwise(0.0)
    by_fuel = F.when(f.contains("electrique") | f.contains("électrique"), 1.5).when(f.contains("hybride"), 0.5).otherwise(0.0)
    return clamp(F.lit(5.0) + by_use + by_co2 + by_fuel)


def reliability(has_sheet: Column, sheet_score: Column, faults: Column, review: Column) -> Column:
    by_faults = F.when(has_sheet, F.when(faults > 5, 5.0).when(faults > 3, 6.0).when(faults > 0, 7.0).otherwise(8.5))
    own = F.when(has_sheet, F.nullif(sheet_score, F.lit(0.0)))
    return F.coalesce(F.round(mean_of_known(own, by_faults, F.nullif(review, F.lit(0.0)) * 2), 1), F.lit(6.0))


def from_five(x: Column, default: float) -> Column:
    return F.coalesce(clamp(F.nullif(x, F.lit(0.0)) * 2), F.lit(default))


def final_note(reliable: Column, comfort: Column, cheap: Column, safe: Column, roomy: Column) -> Column:
    return F.round((reliable * 0.4 + comfort * 0.2 + cheap * 0.2 + safe * 0.1 + roomy * 0.1) * 2, 1)


def badge_level(has_sheet: Column, has_reviews: Column, reviews: Column) -> Column:
    return F.when(has_reviews & (reviews >= 5), "certified").when(has_sheet, "verified").otherwise("estimated")


def badge(level: Column) -> Column:
    """Level, label, colour and description (fixed values)."""
    labels = {"certified": "Certifié", "verified": "Vérifié", "estimated": "Estimé"}
    colors = {"certified": "gold", "verified": "silver", "estimated": "bronze"}
    texts = {"certified": "Données vérifiées par avis réels", "verified": "Données techniques confirmées", "estimated": "Estimation basée sur données similaires"}
    return F.struct(level.alias("level"), lookup(labels, level).alias("label"), lookup(colors, level).alias("color"), lookup(texts, level).alias("description"))


def verdict(name: Column, note: Column, reliable: Column, cheap: Column, comfort: Column) -> Column:
    """A sentence on the note, with up to two strong points and the weak points (fixed wording)."""
    tiers = [(16, "excellent choix", "Nous le recommandons vivement."), (14, "très bon choix", "Un achat que vous ne regretterez pas."), (12, "bon choix", "Une option solide pour votre budget."), (10, "choix correct", "Vérifiez bien l'historique d'entretien.")]
    what, advice = F, F
    for least, q, a in tiers:
        what, advice = what.when(note >= least, q), advice.when(note >= least, a)
    known = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    strong = F.slice(known(F.when(reliable >= 7.5, "fiabilité reconnue"), F.when(cheap >= 7.5, "économique à l'usage"), F.when(comfort >= 7.5, "confort apprécié")), 1, 2)
    weak = known(F.when(reliable < 6, "fiabilité perfectible"), F.when(cheap < 5, "coûts d'utilisation élevés"))
    return F.concat(
        F.lit("Le "), name, F.lit(" est un "), what.otherwise("choix à considérer avec prudence"),
        F.when(F.size(strong) > 0, F.concat(F.lit(", notamment grâce à sa "), F.array_join(strong, ", "))).otherwise(""), F.lit(". "),
        F.when(F.size(weak) > 0, F.concat(F.lit("Attention toutefois à sa "), F.array_join(weak, ", "), F.lit(". "))).otherwise(""),
        advice.otherwise("Nous conseillons une inspection approfondie."),
    )


def quality_label(score: Column) -> Column:
    """Five tiers of a score out of 10."""
    return F.when(score.isNull(), "Non évalué").when(score >= 8.5, "Excellent").when(score >= 7, "Bon").when(score >= 5, "Moyen").when(score >= 3, "À éviter").otherwise("Critique")


def confidence_points(note: Column, reliable: Column, content: Column, km: Column, date: Column, pros: Column, cons: Column) -> Column:
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return flag(note.isNotNull(), 2) + flag(reliable.isNotNull(), 2) + flag(F.length(content) > 50, 2) + flag(km > 0, 1) + flag(date != "", 1) + flag(pros > 0, 1) + flag(cons > 0, 1)


def confidence_level(points: Column) -> Column:
    return F.when(points >= 7, "high").when(points >= 4, "medium").otherwise("low")


def sheet_reliability(faults: Column, engine: Column, gearbox: Column, cons: Column) -> Column:
    base = F.lit(8.0) - F.when(faults > 10, 2.0).when(faults > 5, 1.0).when(faults > 2, 0.5).otherwise(0.0)
    return clamp(base - engine * 0.3 - gearbox * 0.2 + F.when(cons < 3, 0.5).otherwise(0.0))


def sheet_global(reliable: Column, engine_mean: Column, pros: Column, cons: Column) -> Column:
    ratio = F.when(pros + cons > 0, pros / F.greatest(F.lit(1), pros + cons) * 10)
    return F.coalesce(tidy(mean_of_known(F.nullif(reliable, F.lit(0.0)), engine_mean, ratio), 1), F.lit(7.0))


def count_with(items: Column, words: list[str]) -> Column:
    return F.size(F.filter(items, lambda x: contains_any(F.lower(x), words)))


def contextual_reliability(known: Column, faults: Column, reviews: Column, km: Column) -> Column:
    s = F.when(known > 0, known).otherwise(5.0) - F.least(F.coalesce(faults, F.lit(0)) * 0.3, F.lit(2.0)) + F.when((reviews > 50) & (known >= 7), 0.5).otherwise(0.0)
    return clamp(s - F.when((km > 150000) & (s < 7), 0.5).otherwise(0.0))


def fuel_key(fuel: Column, model: Column) -> Column:
    f, m = F.lower(F.coalesce(fuel, F.lit(""))), F.lower(F.coalesce(model, F.lit("")))
    return F.when(contains_any(f, ["electr", "ev"]) | contains_any(m, ["model 3", "model s", "model y", "e-"]), "electrique").when(contains_any(f, ["hybride", "hybrid"]), "hybride").when(contains_any(f, ["diesel", "hdi", "tdi"]), "diesel").otherwise("essence")


def contextual_cost(consumption: Column, fuel: Column, model: Column, price: Column, new_price: Column, segment: Column) -> Column:
    key = fuel_key(fuel, model)
    best, fair, bad = (lookup({k: v[i] for k, v in R.CONSUMPTION_REFERENCES.items()}, key) for i in range(3))
    use = F.when(consumption > 0, F.when(consumption <= best, 2.5).when(consumption <= fair, 1.0).when(consumption >= bad, -1.0).otherwise(0.0)).otherwise(0.0)
    ratio = F.when((new_price > 0) & (price > 0), price / F.nullif(new_price, F.lit(0.0)))
    s = F.lit(5.0) + use + F.when(ratio < 0.4, 1.5).when(ratio < 0.6, 0.5).when(ratio > 0.85, -1.0).otherwise(0.0)
    return clamp(s + F.when(segment.isin("Budget", "Volume") & (s >= 7), 0.5).otherwise(0.0))


def contextual_comfort(pros: Column, cons: Column, segment: Column) -> Column:
    s = F.lit(5.0) + F.least(count_with(pros, R.COMFORT_WORDS) * 0.5, F.lit(2.0)) - F.least(count_with(cons, R.COMFORT_WORDS) * 0.5, F.lit(1.5))
    return clamp(s + F.when(segment.isin("Premium", "Luxury_Sport", "Luxury"), F.when(s >= 7, 1.0).when(s < 5, -0.5).otherwise(0.0)).otherwise(0.0))


def contextual_performance(power: Column, pros: Column, segment: Column) -> Column:
    good, best = (F.coalesce(lookup({k: v[i] for k, v in R.POWER_REFERENCES.items()}, segment), F.lit(R.POWER_REFERENCES["Volume"][i])) for i in range(2))
    s = F.when(power > 0, F.when(power >= best, 2.0).when(power >= good, 1.0).when(power < good * 0.6, -1.0).otherwise(0.0)).otherwise(0.0)
    return clamp(F.lit(5.0) + s + F.least(count_with(pros, R.DYNAMIC_WORDS) * 0.4, F.lit(1.5)))


def contextual_value(price: Column, quote: Column, new_price: Column, year: Column, today: int = 2026) -> Column:
    r = F.when((quote > 0) & (price > 0), price / F.nullif(quote, F.lit(0.0)))
    s = F.when(r < 0.9, F.least((1 - r) * 10, F.lit(2.0))).when(r > 1.1, -F.least((r - 1) * 5, F.lit(1.5))).otherwise(0.0)
    expected = F.coalesce(lookup(dict(enumerate(R.VALUE_BY_AGE)), F.lit(today) - year), F.lit(0.30))
    left = F.when(year.isNotNull() & (new_price > 0) & (price > 0), price / F.nullif(new_price, F.lit(0.0)))
    return clamp(F.lit(5.0) + s + F.when(left > expected * 1.1, 1.5).when(left < expected * 0.85, -1.0).otherwise(0.0))


def contextual_safety(year: Column, pros: Column) -> Column:
    s = F.when(year >= 2022, 2.0).when(year >= 2019, 1.0).when(year < 2015, -1.0).otherwise(0.0)
    return clamp(F.lit(5.0) + s + F.least(count_with(pros, R.SAFETY_WORDS) * 0.5, F.lit(1.5)))


def body_category(model: Column) -> Column:
    m, out = F.lower(model), F
    for name, words in R.CATEGORIES:
        out = out.when(contains_any(m, words), name)
    return out.otherwise("Unknown")


def ownership(consumption: Column, fuel: Column, km: Column | int = 1000) -> Column:
    """Monthly cost: consumption used, its source, fuel, upkeep, month, year."""
    km = F.lit(km) if isinstance(km, int) else km
    known = consumption > 0
    use = F.when(known, consumption).otherwise(lookup(R.DEFAULT_CONSUMPTION, fuel, F.lit(6.5)))
    burnt, kept = km / 100 * use * lookup(R.FUEL_PRICES, fuel, F.lit(1.75)), km * R.MAINTENANCE_PER_KM
    return F.struct(
        F.round(use, 1).alias("consumption"), F.when(known, "ademe").otherwise("estimation").alias("source"), F.round(burnt, 2).alias("fuel"), F.round(kept, 2).alias("upkeep"), F.round(burnt + kept, 2).alias("month"), F.round((burnt + kept) * 12, 2).alias("year")
    )


def insurance(profile: Column, fiscal: Column) -> Column:
    """Insurance a month: a fixed part and one of each fiscal horsepower, by profile; that of a city car for other profiles."""
    fixed, each = (lookup({k: float(v[i]) for k, v in R.INSURANCE.items()}, profile, F.lit(float(R.INSURANCE["citadine"][i]))) for i in (0, 1))
    return F.round((fixed + each * fiscal) / 12, 2)


def upkeep(profile: Column, km: Column) -> Column:
    """Upkeep a year by profile and kilometres a year: 5 % more beyond 25,000, at least 800 below 10,000. Other profiles: the mean rate."""
    cost = km * lookup(R.UPKEEP_PER_KM, profile, F.lit(R.MAINTENANCE_PER_KM))
    return F.round(F.when(km < 10000, F.greatest(F.lit(800.0), cost)).when(km > 25000, cost * 1.05).otherwise(cost), 2)


def alert_engine(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("puretech"), "puretech").when(t.contains("tce"), "tce")


def alert_adjustment(engine: Column) -> Column:
    return lookup({"puretech": -1.5, "tce": -1.0}, engine, F.lit(0.0))


def deal_score(expert: Column, km: Column, year: Column, price: Column, alerts: Column, today: int = 2026) -> Column:
    """From -100 to 100."""
    yearly = F.when((km > 0) & (year > 0), km / F.greatest(F.lit(1), F.lit(today) - year))
    by_km = F.when(yearly < 10000, 20).when(yearly < 15000, 15).when(yearly < 20000, 10).when(yearly.isNotNull(), 5).otherwise(0)
    by_price = F.when(price > 0, F.when(price < 10000, 20).when(price < 20000, 25).when(price < 30000, 30).otherwise(15)).otherwise(0)
    s = F.coalesce(F.nullif(expert, F.lit(0.0)), F.lit(10.0)) / 20 * 40 + by_km + by_price + F.when(alerts == 0, 10).when(alerts == 1, 5).otherwise(0)
    return F.round((s - 50) * 2, 1)


def recommendation(note: Column, reliable: Column) -> Column:
    return F.when((note >= 15) & (reliable >= 7), "excellent").when((note >= 12) & (reliable >= 5), "bon").when(note >= 10, "acceptable").otherwise("prudence")


def crit_air(fuel: Column, year: Column) -> Column:
    petrol = F.when(year >= 2011, 1).when(year >= 2006, 2).otherwise(3)
    return F.when(fuel == "electrique", 0).when(year.isNull(), 3).when(fuel.isin("essence", "hybride", "hybride_rechargeable"), petrol).when((fuel == "diesel") & (year >= 2011), 2).otherwise(3)


def legacy_note(fuel: Column, gearbox: Column, year: Column) -> Column:
    n = F.lit(12.0) + F.when(fuel == "electrique", 2.0).when(fuel == "hybride", 1.5).otherwise(0.0) + F.when(gearbox == "automatique", 0.5).otherwise(0.0) + F.when(year >= 2020, 1.0).otherwise(0.0)
    return clamp(n, 0.0, 20.0)


def recall_penalty(total: Column, critical: Column) -> Column:
    p = F.when(total == 0, 0.0).when(total <= 2, 0.5 * total).when(total <= 5, 1.0 + 0.3 * (total - 2)).when(total <= 10, 2.0 + 0.2 * (total - 5)).otherwise(3.0 + 0.1 * (total - 10))
    return p + 0.5 * critical


def recall_level(total: Column) -> Column:
    return F.when(total == 0, "excellent").when(total <= 2, "bon").when(total <= 5, "moyen").when(total <= 10, "attention").otherwise("critique")
