"""Vehicle labels: normalising, keys, defaults, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autolot.functions import refdata as R
from autolot.functions.text import lookup, title_case
from autolot.operators.rows import keep_first
from autolot.sources.files import first_column

KW_TO_HP = 1.35962


def decimal(text: Column) -> Column:
    """A number with a decimal comma or point; null if it is none."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def fuel(code: Column) -> Column:
    return lookup(R.FUEL_CODES, F.upper(F.trim(code)), F.lit("inconnu"))


def gearbox(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.contains("AUTO") | t.contains("CVT") | t.contains("ROBOT") | (t == "A"), "automatique").when(t.contains("MANU") | (t == "M"), "manuelle").otherwise("inconnu")


def horsepower(kw: Column | None, fiscal: Column | None) -> Column:
    """From kW, else from fiscal power, else 100."""
    if kw is not None:
        return F.bround(decimal(kw) * KW_TO_HP).cast("int")
    return F.bround(decimal(fiscal) * 15).cast("int") if fiscal is not None else F.lit(100)


def year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(y.between(1990, 2030), y).otherwise(F.when(y.isNotNull(), 2020))


def normalise(df: DataFrame) -> DataFrame:
    """Label rows as vehicles before defaults: the first known column of each kind, cleaned, with its key."""
    pick = lambda *names: first_column(df, list(names), F.lit(None).cast("string"))
    kw = next((F.col(f"`{c}`") for c in ("puiss_max", "Puissance maximale") if c in df.columns), None)
    cv = next((F.col(f"`{c}`") for c in ("puiss_fisc", "Puissance fiscale") if c in df.columns), None)
    text = lambda c: F.coalesce(c, F.lit("nan"))
    out = df.select(
        *[c for c in ("n",) if c in df.columns],
        title_case(F.trim(text(first_column(df, ["lib_mrq", "marque"])))).alias("marque"), F.trim(text(first_column(df, ["lib_mod_doss", "lib_mod", "modele"]))).alias("modele"),
        F.substring(F.trim(F.coalesce(pick("dscom"), F.lit(""))), 1, 100).alias("motorisation"), horsepower(kw, cv).alias("puissance"), fuel(pick("cod_cbr", "carburant")).alias("carburant"),
        decimal(pick("conso_mixte")).alias("conso"), pick("co2", "co2_wltp").try_cast("int").alias("co2"), gearbox(pick("boite", "Type de boite")).alias("boite"),
        F.nullif(F.substring(F.trim(F.coalesce(pick("tvv"), F.lit(""))), 1, 20), F.lit("")).alias("tvv"), year(pick("annee")).alias("annee"),
    )
    return out.withColumn("cle", composite_key())


def composite_key() -> Column:
    return F.concat_ws("|", F.lower("marque"), F.lower("modele"), F.lower("motorisation"), F.coalesce(F.col("puissance").cast("string"), F.lit("<NA>")), F.col("carburant"))


def valid() -> Column:
    """Brand and model are there."""
    return ~F.col("marque").isin("", "Nan") & ~F.col("modele").isin("", "nan")


def defaults(df: DataFrame) -> DataFrame:
    """Output defaults: power 100, engine from power, year 2020."""
    p = F.col("puissance").cast("string")
    engine = F.when(F.col("motorisation") == "", F.concat(F.coalesce(p, F.lit("<NA>")), F.lit("ch"))).otherwise(F.col("motorisation"))
    return df.withColumns({"motorisation": engine, "puissance": F.coalesce("puissance", F.lit(100)), "annee": F.coalesce("annee", F.lit(2020))})


def load(df: DataFrame, order: str) -> DataFrame:
    """The whole chain: normalise, drop invalid rows, keep the first of each key, set defaults."""
    return defaults(keep_first(normalise(df).where(valid()), ["cle"], [order]))


def violations(rules: dict[str, Column]) -> Column:
    """Names of broken rules, comma-joined; a rule that is null is not broken."""
    return F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in rules.items()])


def text_of(column: str, least: int, most: int, required: bool = False) -> Column:
    """The text has so many characters; a missing one passes unless it is required."""
    ok = F.length(column).between(least, most)
    return F.coalesce(ok, F.lit(False)) if required else ok


def number_of(column: str, least: float, most: float, required: bool = False) -> Column:
    ok = F.col(column).between(least, most)
    return F.coalesce(ok, F.lit(False)) if required else ok


def vehicle_rules() -> dict[str, Column]:
    """Rules of a vehicle's row, by name."""
    rules = {n: text_of(n, 1, most, required=True) for n, most in R.NAME_LENGTHS.items()}
    rules |= {n: number_of(n, *ends, required=n in R.REQUIRED) for n, ends in R.VEHICLE_RANGES.items()}
    rules["carburant"] = F.coalesce(F.col("carburant").isin(R.FUELS), F.lit(False))
    rules["boite"] = F.col("boite").isin(R.GEARBOXES)
    rules["tvv"] = text_of("tvv", 0, 20)
    rules["annees"] = F.col("annee_fin") >= F.col("annee_debut")
    return rules


def listing_rules() -> dict[str, Column]:
    """Rules of a listing's row, by name."""
    rules = {n: F.coalesce(F.length(n) >= 1, F.lit(False)) for n in ("external_id", "title")}
    rules |= {n: F.col(n) >= 0 for n in ("price", "km")}
    return rules | {n: number_of(n, *ends) for n, ends in R.LISTING_RANGES.items()} | {"zipcode": text_of("zipcode", 0, 10)}


def split_valid(df: DataFrame, rules: dict[str, Column], broken: str = "broken") -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others (quarantine) with the names of the rules they break."""
    marked = df.withColumn(broken, violations(rules))
    return marked.where(F.col(broken) == "").drop(broken), marked.where(F.col(broken) != "")
