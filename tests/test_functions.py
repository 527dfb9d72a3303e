"""Documented examples, boundary values and plain-Python counterparts of column functions and operators."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from autolot.functions import cleaning as C
from autolot.functions import refdata as R
from autolot.functions import scores as S
from autolot.functions import text as T
from autolot.operators import learning, matching, rows, stats, vehicles
from autolot.sources import files
from autolot.streaming import streams


def one(spark, column, **values):
    """A column's value on one row."""
    kinds = {str: StringType(), float: DoubleType(), int: LongType(), type(None): StringType()}
    schema = StructType([StructField(k, kinds[type(v)]) for k, v in values.items()] or [StructField("x", StringType())])
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column).first()[0]


@pytest.mark.parametrize(("designation", "brand", "model"), [("KANGOO (130ch)", "Renault", "kangoo"), ("3008 1.2 PURETECH", "Peugeot", "3008"), ("Peugeot 208 GT", "PEUGEOT", "208"), ("", "x", ""), (None, None, ""), ("(abc) d", "", "abc"), ("X3 20d", "bmw", "x3")])
def test_model_of_designation(spark, designation, brand, model):
    assert one(spark, T.model_of_designation(F.col("d").cast("string"), F.col("b").cast("string")), d=designation, b=brand) == model


def test_title_features(spark):
    f = one(spark, T.features(F.col("t")), t="Peugeot 3008 1.2 Puretech 130ch Allure BVA 2021")
    assert (f.power, f.year, f.gearbox, f.fuel, f.complete) == (130, 2021, "automatique", "essence", True)
    assert one(spark, T.features(F.col("t").cast("string")), t=None).power is None
    t = F.lit("e-208 électrique")
    assert one(spark, T.fuel_in(T.listing_text(t))) == "electrique" and one(spark, T.fuel_in(T.listing_text(F.lit("Peugeot e-208")))) == "inconnu"
    assert one(spark, T.fuel_in(T.listing_text(F.lit("Peugeot e-208")), normalize_keywords=True)) == "electrique"


def test_normalising(spark):
    assert one(spark, T.normalize(F.lit(" Ci-troën_C4  1.6! "))) == "ci troen c4 16" and one(spark, T.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, T.normalize_brand(F.lit("Mercedes-Benz"))) == "mercedes" and one(spark, T.normalize_brand(F.lit("VW"))) == "volkswagen"
    assert one(spark, T.title_case(F.lit("alfa-romeo d'or"))) == "Alfa-Romeo D'Or"


@pytest.mark.parametrize(("text", "n"), [("82.1K", 82100), ("1.2M", 1200000), ("82100", 82100), ("1,5 k", 1500), ("rien", 0)])
def test_suffixed_number(spark, text, n):
    assert one(spark, T.suffixed_number(F.lit(text))) == n


@pytest.mark.parametrize(("text", "n"), [("4/5", 8.0), ("16 / 20", 8.0), ("3,5", 7.0), ("5", 10.0), ("7", 7.0), ("18", 9.0), ("25", None), ("x", None), ("8/0", None)])
def test_rating(spark, text, n):
    assert one(spark, T.rating(F.lit(text))) == n


def test_costs(spark):
    assert one(spark, F.round(F.lit(1500.0) / 100 * 6.0 * 1.695, 2)) == 152.55
    assert one(spark, S.ownership(F.lit(6.0), F.lit("diesel"), 1500)).fuel == 148.5
    assert one(spark, vehicles.horsepower(F.lit("80,9"), None)) == 110 and one(spark, vehicles.horsepower(None, F.lit("5"))) == 75


@pytest.mark.parametrize(("total", "critical", "score"), [(0, 0, 10.0), (1, 0, 9.5), (2, 1, 8.5), (3, 0, 8.7), (5, 0, 8.1), (6, 0, 7.8), (10, 0, 7.0), (11, 0, 6.9), (200, 0, 0.0)])
def test_recall_penalty_edges(spark, total, critical, score):
    assert round(one(spark, S.clamp(10.0 - S.recall_penalty(F.lit(total), F.lit(critical)))), 6) == score


@pytest.mark.parametrize(("consumption", "points"), [(3.9, 7.5), (4.0, 7.0), (5.0, 6.0), (6.0, 5.0), (7.0, 4.0), (8.9, 4.0), (9.0, 3.0), (0.0, 5.0)])
def test_budget_tiers(spark, consumption, points):
    assert one(spark, S.budget(F.lit(consumption), F.lit(150.0), F.lit("essence"))) == points


def test_nulls_in_scores(spark):
    none = F.lit(None).cast("double")
    assert one(spark, S.from_five(none, 7.0)) == 7.0 and one(spark, S.from_five(F.lit(0.0), 6.0)) == 6.0 and one(spark, S.clamp(none)) is None
    assert one(spark, S.mean_of_known(none, none)) is None and one(spark, S.weighted_mean([(none, 0.5), (F.lit(4.0), 0.25)])) == 4.0
    assert one(spark, S.reliability(F.lit(False), none, none, none)) == 6.0


CASES = [("c'est top, bcp de place", True, "beaucoup"), ("très confortable", True, "Bon niveau de confort"), ("bonjour, pas de souci depuis", True, "Fiabilité exemplaire"), ("problème de turbo", False, "Problème de turbo signalé"), ("consomme trop en ville", False, "Consommation élevée"), ("ça craint vraiment", False, "écevant"), ("j'adore cette auto !!!", True, "Apprécié cette auto!"), ("j'adore !!!", True, "")]


@pytest.mark.parametrize(("text", "pro", "part"), CASES)
def test_cleaning(spark, text, pro, part):
    assert part in one(spark, C.clean(F.lit(text), pro))


def test_cleaning_equals_python_rules(spark):
    """The same fixed rules, run by Python's engine, on sentences with accents at the ends of words."""
    rng = random.Random(4)
    words = ["bcp", "pb", "été", "c'est génial", "à mon avis", "très fiable", "tjs", "conso", "ça craint", "voilà", "je suis très déçu", "!!!", "moteur", "boîte lente", "12", "bon après", "rouille", "pas de panne", ", ", "problème d'injection"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(200)]

    def clean(t, pro):
        run = lambda s, rules: [s := re.sub(p, r.replace("$3", r"\3"), s, flags=re.I) for p, r in rules][-1]
        s = run(t.strip(), [(p, "") for p in C.FILLERS]).strip()
        s = run(s, [(rf"\b{k}\b", v) for k, v in C.ABBREVIATIONS.items()])
        s = run(run(s, C.EMOTIONAL).strip(), C.PROS if pro else C.CONS)
        s = re.sub(r"([.,!?;:])([A-Za-zÀ-ÿ])", r"\1 \2", re.sub(r"\s+([.,!?;:])", r"\1", re.sub(r"\s+", " ", s)))
        s = s[:1].upper() + s[1:]
        s = (s + "." if s and s[-1] not in ".!?" else s).strip()
        return s if len(s) >= 10 else ""

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pro in (True, False):
        assert [r[0] for r in df.select(C.clean(F.col("t"), pro)).collect()] == [clean(t, pro) for t in texts]


def test_distinct_items_equal_a_loop(spark):
    rng = random.Random(1)
    words = ["confort", "coffre", "bruit", "moteur", "route", "le", "siège"]
    lists = [[" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 7))] for _ in range(120)]

    def loop(items):
        kept, seen = [], []
        for item in items:
            kw = set(re.findall(f"[{C.LETTERS}]{{3,}}", item.lower())) - set(R.STOP_WORDS)
            if kw and not any(len(kw & s) / min(len(kw), len(s)) > 0.6 for s in seen):
                kept.append(item)
                seen.append(kw)
        return kept

    df = spark.createDataFrame([(x,) for x in lists], "x array<string>")
    assert [r[0] for r in df.select(C.distinct_items(F.col("x"))).collect()] == [loop(x) for x in lists]


def test_risks(spark):
    df = spark.createDataFrame([(1, "Peugeot", 2015, "1.2 puretech"), (2, "Peugeot", 2020, "1.2 puretech"), (3, "", 2015, "1.2"), (4, "Volkswagen", None, "1.4 TSI"), (5, "peugeot", None, "2.0 hdi 1.2 puretech")], "i int, b string, y int, e string")
    run = lambda **k: {r["i"]: (r["severity"], r["malus"]) for r in matching.risks(df, matching.risk_table(spark), "i", F.col("b"), F.col("y"), F.col("e"), **k).collect()}
    assert run() == {1: ("high", -2.5), 4: ("medium", -1.5), 5: ("high", -2.5)}
    assert run(reference_order=True)[5] == ("medium", -1.5)


def test_keep_first_last_write_and_partitions(spark):
    rng = random.Random(3)
    data = [(rng.randrange(20), i, rng.random()) for i in range(400)]
    for n in (1, 7):
        df = spark.createDataFrame(data, "k int, o int, v double").repartition(n)
        first = {r.k: r.o for r in rows.keep_first(df, ["k"], ["o"]).collect()}
        last = {r.k: r.o for r in rows.last_write(df, ["k"], ["o"]).collect()}
        assert first == {k: min(o for a, o, _ in data if a == k) for k in first} and last == {k: max(o for a, o, _ in data if a == k) for k in last}
    again = rows.keep_first(rows.keep_first(df, ["k"], ["o"]), ["k"], ["o"])
    assert again.count() == len(first)


def test_upsert_adds_up(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c"), (None, "m")], "k int, v string")
    got = {r.k: (r.v, r.change) for r in files.upsert(old, new, ["k"]).collect()}
    assert got == {1: ("a", "kept"), 2: (None, "updated"), 3: ("c", "inserted"), None: ("m", "updated")}


def test_first_column(spark):
    df = spark.createDataFrame([(1,)], "b int")
    assert files.first_column(df, ["a", "b"]) is not None and files.first_column(df, ["a"], F.lit(0)) is not None
    with pytest.raises(ValueError):
        files.first_column(df, ["a"])


def test_label_files_with_either_sign(spark):
    df = spark.createDataFrame([("A", "1,5")], "lib_mrq string, puiss_max string")
    for sep in ";,":
        path = files.scratch(spark, "csv")
        df.write.csv(path, header=True, sep=sep)
        assert files.delimiter(spark, path) == sep and files.read_labels(spark, path, 1).first() == ("A", "1,5")


def test_station_defaults(spark):
    got = {r.fuel: (r["mean"], r.stations) for r in stats.station_prices(spark.createDataFrame([("Gazole", "1600"), ("Gazole", "1700"), ("E85", "x")], "name string, raw string")).collect()}
    assert got["diesel"] == (1.65, 2) and got["e85"] == (0.85, 0) and got["essence"] == (1.75, 0)


def test_plans(spark, sf_dir):
    """No cartesian product; the risk table is broadcast; filters and columns reach the scan."""
    from autolot.plans import queries

    text = lambda name: queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    for name in ("c1_c2_match_sheets", "c5_longest_model", "c7_feature_match", "c9_fuzzy_notes", "c13_engine_risks", "c14_year_overlap"):
        assert "CartesianProduct" not in text(name)
    assert "BroadcastHashJoin" in text("c13_engine_risks")
    plan = text("b24_point_lookup")
    assert "EqualTo(p_partkey,42)" in plan and "p_retailprice" not in plan.split("== Physical Plan ==")[1]


def test_ranks_split_no_segment(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", 1.0), ("a", None), ("b", 2.0)], "s string, v double")
    got = sorted((r.s, r.v or 0.0, r["rank"], r.dense_rank, r.percent_rank) for r in rows.segment_ranks(df, "s", "v").collect())
    assert got == [("a", 0.0, 4, 3, 1.0), ("a", 1.0, 3, 2, 2 / 3), ("a", 3.0, 1, 1, 0.0), ("a", 3.0, 1, 1, 0.0), ("b", 2.0, 1, 1, 0.0)]


def test_model_predicts_in_range(spark):
    data = [(f"m{i % 3}", float(i % 50), float(i % 3) * 6) for i in range(300)]
    df = spark.createDataFrame(data, "m string, x double, y double")
    model = learning.train(df, ["m"], ["x"], "y", trees=(5,), depths=(4,), folds=2)
    new = spark.createDataFrame([("m2", 1.0), ("never seen", None)], "m string, x double")
    got = [r.prediction for r in learning.predict(model, new).collect()]
    assert 10 < got[0] <= 20 and all(0 <= p <= 20 for p in got)


def test_fresh_listings_expire(spark):
    path = files.scratch(spark, "captures")
    for minute, ident in ((0, "1"), (3, "1"), (20, "2"), (25, "3"), (30, "1")):
        spark.createDataFrame([("s", ident, f"2024-01-01 00:{minute:02}:00")], "source string, external_id string, t string").selectExpr("source", "external_id", "cast(t as timestamp) AS scraped_at").coalesce(1).write.mode("append").parquet(path)
    got = sorted(r.external_id for r in streams.drain(streams.fresh_listings(streams.read(spark, path)), "fresh").collect())
    assert got == ["1", "1", "2", "3"]  # at minute 3 it is known, at 30 it has expired
