"""Filters of vehicles, listings, labels, recalls and the review queue, on columns that the caller names.

A condition is a boolean column; one whose value is None is left out. Rows whose column is null do not fit it.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KW_PER_HP = 0.7355

# What a fuel asked for stands for in the tables.
FUEL_TERMS = {"essence": ["essence", "ES"], "diesel": ["diesel", "GO", "gazole"], "hybride": ["hybride", "hybrid"], "electrique": ["electrique", "électrique", "EL"]}


def every(*conditions: Column | None) -> Column:
    """All conditions that are there."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def holds(column: str, value: str | None) -> Column | None:
    """The text holds the value, in any case."""
    return None if value is None else F.contains(F.lower(column), F.lit(value.lower()))


def begins(column: str, value: str | None) -> Column | None:
    return None if value is None else F.startswith(F.lower(column), F.lit(value.lower()))


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def within(column: str, least=None, most=None) -> Column | None:
    """least <= column <= most; an end that is None is open."""
    ends = [F.col(column) >= F.lit(least) if least is not None else None, F.col(column) <= F.lit(most) if most is not None else None]
    return every(*ends) if any(e is not None for e in ends) else None


def fuel_terms(column: str, fuel: str | None) -> Column | None:
    """One of the fuel's terms occurs in the column, in any case; an unknown fuel is its own term."""
    if fuel is None:
        return None
    return reduce(or_, [holds(column, t) for t in FUEL_TERMS.get(fuel.lower(), [fuel])])


def label_rows(df: DataFrame, order: str, brand: str | None = None, models: str | None = None, horsepower: int | None = None, fuels: list[str] | None = None, *, brand_column: str = "marque", model_columns: tuple[str, ...] = ("modele",), power_column: str = "kw", fuel_column: str = "carburant", span: int = 7, most: int = 50) -> DataFrame:
    """The first `most` label rows by `order` that fit, with `ch`: horsepower of their kW, cut to a whole number."""
    power = None if horsepower is None else F.abs(F.col(power_column) - int(horsepower * KW_PER_HP)) <= span
    model = None if models is None else reduce(or_, [holds(c, models) for c in model_columns])
    fit = every(holds(brand_column, brand), model, power, None if fuels is None else F.col(fuel_column).isin(fuels))
    return df.where(fit).orderBy(order).limit(most).withColumn("ch", F.floor(F.col(power_column) / KW_PER_HP).cast("int"))


def vehicle_list(brand: str | None = None, fuels: list[str] | None = None, *, brand_column: str = "marque", fuel_column: str = "carburant") -> Column:
    """Vehicles by the beginning of the brand and alternatives of fuel."""
    return every(begins(brand_column, brand), None if not fuels else reduce(or_, [holds(fuel_column, f) for f in fuels]))


def vehicle_search(brand: str | None = None, model: str | None = None, fuel: str | None = None, text: str | None = None, *, brand_column: str = "marque", model_column: str = "modele", key: Column | None = None, fuel_column: str = "carburant") -> Column:
    """Vehicles by the beginning of the brand, a model in the search key or the model, and a fuel.

    Only without brand and model, the first word of `text` is the brand and its second the model. The search key is brand and
    model without blanks and hyphens, unless `key` is given.
    """
    if text and not brand and not model:
        words = [*text.split()[:2], None, None]
        brand, model = words[0], words[1]
    key = F.regexp_replace(F.lower(F.concat(brand_column, model_column)), r"[\s\-]", "") if key is None else F.lower(key)
    found = None if not model else F.contains(key, F.lit(model.lower().replace(" ", "").replace("-", ""))) | holds(model_column, model)
    return every(begins(brand_column, brand or None), found, fuel_terms(fuel_column, fuel))


def listing_filter(prices: tuple = (None, None), most_km: float | None = None, years: tuple = (None, None), fuel: str | None = None, gearbox: str | None = None, brand: str | None = None, model: str | None = None, *, columns: dict[str, str] | None = None) -> Column:
    """Listings by price, mileage, year, fuel, gearbox, brand and model; `columns` renames what they are called in the table."""
    c = {n: n for n in ("price", "km", "year", "fuel", "gearbox", "marque", "modele")} | (columns or {})
    ranges = [within(c["price"], *prices), within(c["km"], None, most_km), within(c["year"], *years)]
    return every(*ranges, equals(c["fuel"], fuel), equals(c["gearbox"], gearbox), equals(c["marque"], brand), equals(c["modele"], model))


def recall_search(brand: str | None = None, model: str | None = None, *, brand_column: str = "brand_field", product: str = "product", category: str = "category", cars: str = "automobiles") -> Column:
    """Recalls of cars whose brand or product holds the brand, and whose product holds the model, in any case."""
    named = None if brand is None else F.coalesce(holds(brand_column, brand), F.lit(False)) | holds(product, brand)
    return every(equals(category, cars), named, holds(product, model))


def vehicle_filter(brand: str | None = None, model: str | None = None, power: int | None = None, fuel: str | None = None, gearbox: str | None = None, year: int | None = None, *, span: int = 10, years: int = 1) -> Column:
    """Vehicles that fit a title's features: brand equal in any case, model contained, power at most `span` away, fuel and gearbox
    equal unless `inconnu`, production at most `years` away from the year; production without an end goes on."""
    made = None if year is None else (F.col("annee_debut") <= year + years) & (F.col("annee_fin").isNull() | (F.col("annee_fin") >= year - years))
    known = lambda v: None if v == "inconnu" else v
    same = None if brand is None else F.lower("marque") == brand.lower()
    near = None if power is None else within("puissance", power - span, power + span)
    return every(same, holds("modele", model), near, equals("carburant", known(fuel)), equals("boite", known(gearbox)), made)


def confidence(brand: Column, model: Column, power: Column, fuel: Column, gearbox: Column, year: Column) -> Column:
    """Mean of the factors of the features found (model 0.9, gearbox 0.8, others 1), to two digits; 0 if there are none."""
    found = [(brand.isNotNull(), 1.0), (model.isNotNull(), 0.9), (power.isNotNull(), 1.0), (fuel != "inconnu", 1.0), (gearbox != "inconnu", 0.8), (year.isNotNull(), 1.0)]
    total = reduce(add, [F.when(c, w).otherwise(0.0) for c, w in found])
    return F.round(total / F.greatest(F.lit(1), reduce(add, [c.cast("int") for c, _ in found])), 2)


def queue(df: DataFrame, pending: Column, failure: Column, order: list[str], status: str = "status", errors: str = "errors") -> DataFrame:
    """Pending rows, oldest first, with their new state: `processed`, or `failed` where `failure` names an error, which is appended
    to the errors so far (an array; a table without that column starts with none)."""
    before = F.coalesce(F.col(errors), F.array().cast("array<string>")) if errors in df.columns else F.array().cast("array<string>")
    rows = df.where(pending).orderBy(*order)
    return rows.withColumns({status: F.when(failure.isNull(), "processed").otherwise("failed"), errors: F.when(failure.isNull(), before).otherwise(F.array_append(before, failure))})
