"""Matching by containment and by features, filters and rules, held against plain Python on small rows with odd values."""

from __future__ import annotations

from pyspark.sql import functions as F

from autolot.functions import scores as S
from autolot.operators import filters, learning, matching, vehicles

LEFT = [("a", "golf gti 1.4", "golf"), ("a", "208 puretech", "208"), ("a", "", ""), ("b", "golf gti 1.4", "golf"), ("a", "c3", "c3"), ("a", None, "x"), ("a", "ab", None), ("a", "golf gti 1.4", "golf")]
RIGHT = [("a", "golf", 3), ("a", "golf gti", 2), ("a", "golfe", 1), ("a", "c3 ii", 5), ("a", "c", 9), ("a", "", 0), ("a", None, 4), ("b", "208", 7), ("a", "08 p", 6), ("a", "golf", 3)]


def test_partial_match_equals_all_pairs(spark):
    left = spark.createDataFrame(LEFT, "block string, text string, model string")
    right = spark.createDataFrame(RIGHT, "rb string, other string, hit int").withColumnRenamed("rb", "block")
    got = {(r.block, r.text, r.model): r.hit for r in matching.partial_match(left, right, "block", "text", "model", "other", "hit").collect()}
    want = {}
    for b, t, m in set(LEFT):
        hits = [h for rb, o, h in RIGHT if rb == b and o is not None and ((o != "" and t is not None and o in t) or (m not in (None, "") and m in o))]
        if hits and t is not None and m is not None:  # a name without text or model is no name
            want[b, t, m] = min(hits)
    assert {k: v for k, v in got.items() if None not in k} == want


def test_containing_has_each_pair_once(spark):
    whole = spark.createDataFrame([(1, "a", "aaaaaaaab"), (2, "a", "xabcdex"), (3, None, "abcde"), (4, "a", None), (5, "a", "ab")], "w int, block string, text string")
    parts = spark.createDataFrame([(1, "a", "aaaaab"), (2, "a", "abcde"), (3, "a", "ab"), (4, "a", "abcdf"), (5, "a", ""), (6, "a", None), (7, None, "ab")], "p int, pb string, part string")
    got = sorted((r.w, r.p) for r in matching.containing(whole, parts, "block", "text", "pb", "part").collect())
    assert got == [(1, 1), (1, 3), (2, 2), (2, 3), (5, 3)]


def test_first_beginning(spark):
    left = spark.createDataFrame([("a", "gol"), ("a", "golfs"), ("a", "g"), (None, "gol"), ("a", "")], "b string, start string")
    right = spark.createDataFrame([("a", "golf", 1), ("a", "gold", 5), ("a", "", 9), ("a", None, 8), (None, "golf", 7)], "rb string, text string, best int")
    got = {(r.b, r.start): r.best for r in matching.first_beginning(left, right, "b", "start", "rb", "text", "best").collect()}
    assert got.pop(("a", ""), 9) == 9 and got == {("a", "gol"): 5, ("a", "g"): 5}


def test_stepwise_lookup(spark):
    left = spark.createDataFrame([("vw", "golf"), ("vw", "pol"), ("vw", "none"), ("kia", "x")], "b string, m string")
    right = spark.createDataFrame([(1, "vw", "golf", 3), (2, "vw", "golf", 3), (3, "vw", "polo", 9), (4, "vw", "polo ii", 9), (5, "vw", "up", None)], "id int, vb string, vm string, note int")
    got = {(r.b, r.m): (r.step, r.id) for r in matching.stepwise_lookup(left, right, "b", "m", "vb", "vm", "note", "id").collect()}
    assert got == {("vw", "golf"): (1, 1), ("vw", "pol"): (2, 3), ("vw", "none"): (3, 3), ("kia", "x"): (4, None)}


def test_feature_match_equals_all_pairs(spark):
    cars = [(1, "VW", "Golf", 90, "diesel"), (2, "VW", "Golf GTI", 200, "essence"), (3, "Kia", "Rio", 85, "essence"), (4, "Kia", "golf cart", None, "electrique"), (5, None, "Golf", 100, None)]
    asked = [(b, m, p, f) for b in ("vw", "Kia", "Fiat", None) for m in ("GOLF", "rio", None) for p in (80, 100, 191, 210, None) for f in ("diesel", "essence", "inconnu", None)]
    got = matching.feature_match(spark.createDataFrame(asked, "brand string, model string, power int, fuel string"), spark.createDataFrame(cars, "id int, marque string, modele string, puissance int, carburant string"), "id").collect()
    low = lambda x: (x or "").lower()
    assert len(got) == len(asked)
    for r in got:
        fit = [i for i, b, m, p, f in cars if (r.brand is None or low(b) == low(r.brand)) and low(r.model) in low(m) and (r.power is None or (p is not None and abs(p - r.power) <= 10)) and (r.fuel in (None, "inconnu") or f == r.fuel)]
        assert (r.id, r.match_type) == ((min(fit), "exact") if fit else (None, "fallback_power_based")), r


def test_filters_leave_out_what_is_not_asked(spark):
    df = spark.createDataFrame([(1, "Tesla", "Model 3", "electrique", 5), (2, "tesla", "Model-3 LR", "electrique", None), (3, "Kia", "Model 3", None, 7), (4, None, None, None, None)], "id int, marque string, modele string, carburant string, price int")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(filters.vehicle_search()) == [1, 2, 3, 4]
    assert ids(filters.vehicle_search("TES", "model 3")) == [1, 2] and ids(filters.vehicle_search(text="tesla model")) == [1, 2]
    assert ids(filters.vehicle_search("kia", text="tesla model")) == [3] and ids(filters.vehicle_search(text="  ")) == [1, 2, 3, 4]
    assert ids(filters.vehicle_search(fuel="electrique")) == [1, 2] and ids(filters.vehicle_list("t", ["ELEC"])) == [1, 2]
    assert ids(filters.listing_filter((None, 6))) == [1] and ids(filters.listing_filter(columns={"marque": "marque"}, brand="Kia")) == [3]
    assert ids(filters.vehicle_filter("TESLA", None, None, "inconnu")) == [1, 2]


def test_queue_appends_errors(spark):
    df = spark.createDataFrame([(1, 2, ["old"]), (2, 1, None), (3, 0, [])], "id int, ts int, errors array<string>")
    got = filters.queue(df, F.col("id") < 3, F.when(F.col("id") == 1, "bad"), ["ts"]).collect()
    assert [(r.id, r.status, r.errors) for r in got] == [(2, "processed", []), (1, "failed", ["old", "bad"])]


def test_rules_split_rows(spark):
    columns = "id int, marque string, modele string, motorisation string, puissance int, carburant string, boite string, annee_debut int, annee_fin int, tvv string, conso double, co2 int"
    rows = [(1, "VW", "Golf", "1.4", 90, "diesel", "manuelle", 2000, None, None, None, None), (2, None, "", "1.4", None, None, "cvt", 1980, 1970, "x" * 21, 31.0, -1)]
    good, bad = vehicles.split_valid(spark.createDataFrame(rows, columns), vehicles.vehicle_rules())
    assert [r.id for r in good.collect()] == [1] and good.columns == [c.split()[0] for c in columns.split(", ")]
    assert [(r.id, r.broken) for r in bad.collect()] == [(2, "marque,modele,puissance,annee_debut,annee_fin,co2,conso,carburant,boite,tvv,annees")]


def test_costs_and_buckets(spark):
    df = spark.createDataFrame([("citadine", 6, 15000), ("suv", 8, 30000), (None, 6, 1000)], "p string, cv int, km int")
    got = df.select(S.insurance(F.col("p"), F.col("cv")), S.upkeep(F.col("p"), F.col("km"))).collect()
    assert [tuple(r) for r in got] == [(49.17, 1260.0), (75.83, 3307.5), (49.17, 800.0)]
    parts = spark.range(10000).select(learning.bucket("id").alias("b"))
    share = parts.where("b < 8").count() / 10000
    assert 0.78 < share < 0.82 and parts.where("b is null or b < 0 or b > 9").count() == 0
