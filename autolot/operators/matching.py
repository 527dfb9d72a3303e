"""Matching of entities across sources by brand and model.

Joins are equi-joins on a key or a brand block; conditions such as containment only filter a block. Of
several hits the one with the least order is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autolot.functions import refdata as R
from autolot.sources.files import materialize, small


def exact_match(left: DataFrame, right: DataFrame, ident: str, keys: list[str], key: str, hit: str) -> DataFrame:
    """`left` with `hit` of the row of `right` whose key equals the first of `keys` that any has. Keys of `right` are unique."""
    out = left
    for i, k in enumerate(keys):
        out = out.join(right.select(F.col(key).alias(f"_k{i}"), F.col(hit).alias(f"_h{i}")), F.col(k) == F.col(f"_k{i}"), "left")
    return out.select(*left.columns, F.coalesce(*[F.col(f"_h{i}") for i in range(len(keys))]).alias(hit))


#: Parts meet texts by one of their runs of so many characters; shorter parts as they are.
GRAM = 4


def pieces(text: Column, sizes: list[int]) -> Column:
    """Different pieces of a text of the given numbers of characters; none of a null text."""
    def of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: i + n - 1 <= F.length(text))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def candidates(whole: DataFrame, parts: DataFrame, block: str, text: str, part_block: str, part: str, size: int = GRAM) -> DataFrame:
    """Pairs of a block that may hold each other, each once, with the columns of both: those where the text has the rarest of the part's runs.

    A part is filed under the run of `size` characters that the fewest texts of its block have, so names that begin or end alike
    do not meet for that. Parts with a run that no text of the block has are in no text, and take no part.
    """
    known = parts.where(F.col(part) != "")
    n = F.least(F.length(part), F.lit(size))
    sizes = sorted(r[0] for r in known.select(n).distinct().collect())  # at most `size` numbers
    if not sizes:
        sizes = [size]
    texts = whole.select(F.col(block).alias("_tb"), F.col(text).alias("_t")).where("_tb is not null").distinct()
    counts = texts.select("_tb", F.explode(pieces(F.col("_t"), sizes)).alias("_piece")).groupBy("_tb", "_piece").agg(F.count("*").alias("_n"))
    names = known.select(F.col(part_block).alias("_pb"), F.col(part).alias("_part"), n.alias("_size")).distinct()
    runs = F.transform(F.sequence(F.lit(1), F.length("_part") - F.col("_size") + 1), lambda i: F.substring(F.col("_part"), i, F.col("_size")))
    runs = names.select("_pb", "_part", F.explode(F.array_distinct(runs)).alias("_run"))
    found = runs.join(counts, (F.col("_pb") == F.col("_tb")) & (F.col("_run") == F.col("_piece")), "left")
    filed = found.groupBy("_pb", "_part").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("_a")).where("_a.n > 0").select("_pb", "_part", F.col("_a._run").alias("_run"))
    cut = whole.withColumn("_piece", F.explode(pieces(F.col(text), sizes)))
    first = known.join(filed, (F.col(part_block) == F.col("_pb")) & (F.col(part) == F.col("_part"))).drop("_pb", "_part")
    return cut.join(first, (F.col(block) == F.col(part_block)) & (F.col("_piece") == F.col("_run"))).drop("_piece", "_run")


def containing(whole: DataFrame, parts: DataFrame, block: str, text: str, part_block: str, part: str) -> DataFrame:
    """Pairs of a block where `text` of `whole` holds `part` of `parts`, each pair once, with the columns of both (all names differ).

    An empty or null part is in no text, and a null block equals none. See `candidates` for which pairs are compared.
    """
    return candidates(whole, parts, block, text, part_block, part).where(F.col(text).contains(F.col(part)))


def partial_match(left: DataFrame, right: DataFrame, block: str, text: str, model: str, other: str, hit: str) -> DataFrame:
    """Different (block, text, model) of `left` with the least `hit` of those rows of `right` in the block whose `other`
    occurs in the text, or holds the model. Rows, texts and models that agree are matched once."""
    asked = left.select(block, text, model).distinct()
    known = right.groupBy(F.col(block).alias("_b"), other).agg(F.min(hit).alias(hit))
    texts = containing(asked.select(block, text).distinct(), known, block, text, "_b", other)
    texts = texts.groupBy(F.col(block).alias("_tb"), F.col(text).alias("_t")).agg(F.min(hit).alias("_by_text"))
    models = containing(known, asked.select(block, model).distinct(), "_b", other, block, model)
    models = models.groupBy(F.col(block).alias("_mb"), F.col(model).alias("_m")).agg(F.min(hit).alias("_by_model"))
    found = asked.join(texts, (F.col(block) == F.col("_tb")) & (F.col(text) == F.col("_t")), "left")
    found = found.join(models, (F.col(block) == F.col("_mb")) & (F.col(model) == F.col("_m")), "left")
    return found.select(block, text, model, F.least("_by_text", "_by_model").alias(hit)).where(F.col(hit).isNotNull())


def first_containing(left: DataFrame, right: DataFrame, block: str, part: str, right_block: str, text: str, hit: str) -> DataFrame:
    """Different (block, part) of `left` with the least `hit` of the rows of `right` whose text holds the part."""
    known = right.groupBy(right_block, text).agg(F.min(hit).alias(hit))
    pairs = containing(known, left.select(block, part).distinct(), right_block, text, block, part)
    return pairs.groupBy(block, part).agg(F.min(hit).alias(hit))


def first_beginning(left: DataFrame, right: DataFrame, block: str, start: str, right_block: str, text: str, best: str) -> DataFrame:
    """Different (block, start) of `left` with the greatest `best` of the rows of `right` whose text begins so.

    Every beginning of a text gets its best row before the join, which is then on equal keys alone.
    """
    lengths = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    begun = right.select(F.col(right_block).alias("_b"), F.col(best), F.explode(F.transform(lengths, lambda n: F.substring(F.col(text), F.lit(1), n))).alias("_s"))
    begun = begun.groupBy("_b", "_s").agg(F.max(best).alias(best))
    asked = left.select(block, start).distinct()
    return asked.join(begun, (F.col(block) == F.col("_b")) & (F.col(start) == F.col("_s"))).select(block, start, best)


def stepwise_lookup(left: DataFrame, right: DataFrame, brand: str, model: str, right_brand: str, right_model: str, note: str, ident: str) -> DataFrame:
    """Different (brand, model) of `left` with a row of `right` of that brand, and the step that found it.

    1: the same model; 2: a model that holds the one asked for; 3: the best note of the brand; 4: none (null). Within a step
    the highest note wins, then the least ident. Names are normalised by the caller.
    """
    asked = left.select(brand, model).distinct()
    best = F.max_by(F.struct(note, ident), F.struct(F.col(note), -F.col(ident)))
    known = right.groupBy(F.col(right_brand).alias("_b"), F.col(right_model).alias("_m")).agg(best.alias("_r"))
    top = F.max_by("_r", F.struct(F.col(f"_r.{note}"), -F.col(f"_r.{ident}")))
    same = known.select("_b", "_m", F.col(f"_r.{ident}").alias("_1"))
    part = containing(known, asked, "_b", "_m", brand, model).groupBy(F.col(brand).alias("_pb"), F.col(model).alias("_pm")).agg(top.alias("_p"))
    whole = known.groupBy(F.col("_b").alias("_wb")).agg(top.alias("_w"))
    found = asked.join(same, (F.col(brand) == F.col("_b")) & (F.col(model) == F.col("_m")), "left")
    found = found.join(part, (F.col(brand) == F.col("_pb")) & (F.col(model) == F.col("_pm")), "left").join(whole, F.col(brand) == F.col("_wb"), "left")
    hits = [F.col("_1"), F.col(f"_p.{ident}"), F.col(f"_w.{ident}")]
    step = F.coalesce(*[F.when(h.isNotNull(), n) for n, h in enumerate(hits, 1)], F.lit(4))
    return found.select(brand, model, step.alias("step"), F.coalesce(*hits).alias(ident))


def feature_match(asked: DataFrame, vehicles: DataFrame, ident: str, brand: str = "marque", model: str = "modele", power: str = "puissance", fuel: str = "carburant", span: int = 10) -> DataFrame:
    """Different (brand, model, power, fuel) of titles with the least `ident` of the vehicles that fit, and `match_type`.

    Brand and fuel are equal, the vehicle's model holds the title's, its power is at most `span` away; all but fuel in any
    case. A feature that is null (a fuel: or `inconnu`) asks for nothing. `match_type` is `exact`, or `fallback_power_based`
    where no vehicle fits. Every combination of features left open has its own rolled-up vehicles, so that joins are on
    equal keys throughout: block of brand and fuel, model names that hold each other, and powers by steps of `span`.
    """
    part = lambda c: F.coalesce(F.lower(c), F.lit("*"))
    keys = asked.select("brand", "model", "power", "fuel").distinct()
    keys = materialize(keys.select("*", F.concat_ws("|", part("brand"), part(F.nullif("fuel", F.lit("inconnu")))).alias("_block"), F.lower(F.coalesce("model", F.lit(""))).alias("_model")), "keys")
    wanted = keys.select("_block", "_model").distinct()
    # Vehicles that agree in all four are one; each gets only those of its four blocks that are asked for.
    cars = vehicles.groupBy(F.lower(brand).alias("_brand"), F.lower(fuel).alias("_fuel"), F.lower(model).alias("_name"), F.col(power).alias("_power")).agg(F.min(ident).alias("_id"))
    blocks = F.array(*[F.concat_ws("|", x, y) for x in (F.col("_brand"), F.lit("*")) for y in (F.col("_fuel"), F.lit("*"))])
    known = cars.select("_name", "_power", "_id", F.explode(blocks).alias("_vb"))
    known = known.join(wanted.select(F.col("_block").alias("_vb")).distinct(), "_vb", "left_semi").groupBy("_vb", "_name", "_power").agg(F.min("_id").alias("_id"))
    known = materialize(known, "blocks")
    # Which names of a block hold the model that is asked for; without a model all do, so its vehicles are rolled up over names.
    pairs = containing(known.select("_vb", "_name").distinct(), wanted, "_vb", "_name", "_block", "_model").select("_block", "_model", "_name")
    named = known.join(pairs.withColumnRenamed("_block", "_vb"), ["_vb", "_name"]).groupBy(F.col("_vb").alias("_block"), "_model", "_power").agg(F.min("_id").alias("_id"))
    every = known.join(wanted.where("_model = ''").select(F.col("_block").alias("_vb")), "_vb", "left_semi").groupBy(F.col("_vb").alias("_block"), F.lit("").alias("_model"), "_power").agg(F.min("_id").alias("_id"))
    cells = materialize(named.unionByName(every), "cells")  # the cells of the lattice that are asked for, by power
    step = lambda c: F.floor(F.col(c) / span)
    near = keys.where("power is not null").select("_block", "_model", "power").distinct().withColumn("_step", F.explode(F.array(step("power") - 1, step("power"), step("power") + 1)))
    near = near.join(cells.withColumn("_step", step("_power")), ["_block", "_model", "_step"]).where(F.abs(F.col("_power") - F.col("power")) <= span).groupBy("_block", "_model", "power").agg(F.min("_id").alias("_id"))
    free = cells.groupBy("_block", "_model").agg(F.min("_id").alias("_id")).withColumn("power", F.lit(None).cast(keys.schema["power"].dataType))
    hits = near.unionByName(free.select(near.columns)).select(F.col("_block").alias("_hb"), F.col("_model").alias("_hm"), F.col("power").alias("_hp"), F.col("_id").alias(ident))
    out = keys.join(hits, (F.col("_block") == F.col("_hb")) & (F.col("_model") == F.col("_hm")) & F.col("power").eqNullSafe(F.col("_hp")), "left")
    return out.select("brand", "model", "power", "fuel", ident, F.when(F.col(ident).isNotNull(), "exact").otherwise("fallback_power_based").alias("match_type"))


def blend_reliability(vehicles: DataFrame, reviews: DataFrame, recalls: DataFrame, keys: list[str], review_score: str, recall_score: str, shares: tuple[float, float] = (0.7, 0.3), estimate: float = 7.0) -> DataFrame:
    """`fiabilite` of each vehicle: the reviews' and the recalls' scores by their `shares`; the one there is; else `estimate`."""
    both = vehicles.join(reviews.select(*keys, F.col(review_score).alias("_f")), keys, "left").join(recalls.select(*keys, F.col(recall_score).alias("_s")), keys, "left")
    blend = F.when(F.col("_f").isNotNull() & F.col("_s").isNotNull(), F.col("_f") * shares[0] + F.col("_s") * shares[1])
    return both.select(*vehicles.columns, F.round(F.coalesce(blend, "_s", "_f", F.lit(estimate)), 3).alias("fiabilite"))


def match(left: DataFrame, right: DataFrame, ident: str, keys: list[str], key: str, block: str, text: str, model: str, other: str, hit: str) -> DataFrame:
    """Exact match, then a partial match of the rest; `step` says which: exact, partial, none."""
    exact = exact_match(left, right, ident, keys, key, hit)
    part = partial_match(exact.where(F.col(hit).isNull()), right, block, text, model, other, hit).toDF("_pb", "_pt", "_pm", "_p")
    on = (F.col(block) == F.col("_pb")) & (F.col(text) == F.col("_pt")) & (F.col(model) == F.col("_pm")) & F.col(hit).isNull()
    step = F.when(F.col(hit).isNotNull(), "exact").when(F.col("_p").isNotNull(), "partial").otherwise("none")
    return exact.join(part, on, "left").select(*left.columns, F.coalesce(F.col(hit), F.col("_p")).alias(hit), step.alias("step"))


#: A word, or what stands between two words; a name without what stands around its words.
PIECES, WORD, INNER = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+", r"^[^\p{L}\p{N}_]*(.*?)[^\p{L}\p{N}_]*$"


def filed_models(models: DataFrame, model: str) -> DataFrame:
    """_m, _name, _word, _at, _n: each model under that of its words which the fewest models have (ties: the first), where it stands
    among the name's pieces, and the name's number of pieces."""
    name = F.regexp_extract(F.lower(F.trim(model)), INNER, 1)
    known = models.select(F.col(model).alias("_m"), name.alias("_name")).where("_name <> ''").distinct()
    words = known.select("_m", "_name", F.posexplode(F.regexp_extract_all("_name", F.lit(PIECES), 0)).alias("_at", "_word")).where(F.col("_at") % 2 == 0)  # it begins with a word
    counts = words.select("_name", "_word").distinct().groupBy("_word").agg(F.count("*").alias("_c"))
    best = words.join(counts, "_word").groupBy("_m", "_name").agg(F.min(F.struct("_c", "_at", "_word")).alias("_a"))
    return best.select("_m", "_name", F.col("_a._word").alias("_word"), F.col("_a._at").alias("_at"), F.size(F.regexp_extract_all("_name", F.lit(PIECES), 0)).alias("_n"))


def longest_model(titles: DataFrame, models: DataFrame, ident: str, title: str, model: str) -> DataFrame:
    """The longest known model (ties: the first by name) that stands in the title between word boundaries.

    A title's words, each once, meet the models that are filed under them; then the whole name is compared at that place. So a title is
    held against few models, and what is made of it goes with its words, however long the longest model is. Models begin and end
    with a letter or digit; signs around them are cut off. The dictionary is broadcast if its bytes allow it.
    """
    asked = titles.select(ident, F.regexp_extract_all(F.lower(title), F.lit(PIECES), 0).alias("_p"))
    # An outer explode: for a plain one Spark also filters on the size of the pieces, and works them out once more.
    word = asked.select(ident, "_p", F.posexplode_outer("_p").alias("_i", "_word")).where(F.col("_word").rlike("^" + WORD))
    start = F.col("_i") - F.col("_at")
    same = (start >= 0) & (F.array_join(F.slice("_p", start + 1, F.col("_n")), "") == F.col("_name"))
    met = word.join(small(filed_models(models, model)), "_word").where(F.when(start >= 0, same).otherwise(False))
    return met.groupBy(ident).agg(F.min_by("_m", F.struct(-F.length("_m"), F.col("_m"))).alias(model))


def risks(rows: DataFrame, table: DataFrame, ident: str, brand: Column, year: Column, engine: Column, reference_order: bool = False) -> DataFrame:
    """Documented risks of rows that have any: ids, highest severity, malus.

    A risk fits if its brand equals (vw: volkswagen), its engine tokens occur in the engine text, and the year, if known, lies in
    its half-open range; an empty brand has none. `reference_order` takes the severity that is last by name.
    """
    b = F.lower(F.trim(F.coalesce(brand, F.lit(""))))
    b = F.when(b == "volkswagen", "vw").otherwise(b)
    left = rows.select(ident, b.alias("_brand"), year.alias("_year"), F.lower(F.coalesce(engine, F.lit(""))).alias("_engine"))
    hit = left.join(table, (F.col("_brand") == F.col("brand")) & (F.col("_year").isNull() | ((F.col("_year") >= F.col("first")) & (F.col("_year") < F.col("last")))) & F.exists("tokens", lambda t: F.col("_engine").contains(t)))
    order = F.col("severity") if reference_order else F.create_map([F.lit(x) for kv in R.SEVERITY_RANK.items() for x in kv])[F.col("severity")]
    out = hit.groupBy(ident).agg(F.array_join(F.sort_array(F.collect_list("risk")), ",").alias("risks"), F.max_by("severity", order).alias("severity"))  # at most seven risks a row
    return out.withColumn("malus", F.create_map([F.lit(x) for kv in R.SEVERITY_MALUS.items() for x in kv])[F.col("severity")])


def risk_table(spark) -> DataFrame:
    rows = [(k, k.split("_")[0], s, a, b, k.split("_")[1:]) for k, s, a, b in R.RISKS]
    return F.broadcast(spark.createDataFrame(rows, "risk string, brand string, severity string, first int, last int, tokens array<string>"))  # seven rows
