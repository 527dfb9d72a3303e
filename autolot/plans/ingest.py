"""Queries of sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from autolot.operators import filters, vehicles
from autolot.plans.lifts import frame, sql
from autolot.plans.registry import query
from autolot.sources import buckets, files, records
from autolot.functions import refdata as R
from autolot.plans.sqltext import dbl, values

S = sql("labels_csv")
FUELS = values(list(R.FUEL_CODES.items()), "f(code, fuel)")
TITLED = r"array_to_string(list_transform(regexp_extract_all(lower(trim(coalesce(lib_mrq, 'nan'))), '([\p{L}]+|[^\p{L}]+)'), lambda w: upper(w[1]) || w[2:]), '')"
NORMAL = dbl(f"""(SELECT n, {TITLED} AS marque, trim(coalesce(lib_mod_doss, 'nan')) AS modele, trim(coalesce(dscom, ''))[1:100] AS motorisation,
 CAST(round_even(try_cast(replace(puiss_max, ',', '.') AS DOUBLE) * 1.35962, 0) AS INT) AS puissance, coalesce((SELECT any_value(fuel) FROM {FUELS} WHERE code = upper(trim(cod_cbr))), 'inconnu') AS carburant,
 try_cast(replace(conso_mixte, ',', '.') AS DOUBLE) AS conso, CASE WHEN regexp_full_match(co2, '[0-9]+') THEN CAST(co2 AS INT) END AS co2,
 CASE WHEN regexp_matches(upper(boite), 'AUTO|CVT|ROBOT') OR upper(trim(boite)) = 'A' THEN 'automatique' WHEN upper(boite) LIKE '%MANU%' OR upper(trim(boite)) = 'M' THEN 'manuelle' ELSE 'inconnu' END AS boite,
 nullif(trim(coalesce(tvv, ''))[1:20], '') AS tvv, CASE WHEN try_cast(annee AS INT) IS NULL THEN NULL WHEN try_cast(annee AS INT) BETWEEN 1990 AND 2030 THEN CAST(annee AS INT) ELSE 2020 END AS annee FROM {S})""")
KEY = "lower(marque) || '|' || lower(modele) || '|' || lower(motorisation) || '|' || coalesce(CAST(puissance AS VARCHAR), '<NA>') || '|' || carburant"
VALID = "marque NOT IN ('', 'Nan') AND modele NOT IN ('', 'nan')"


def normal(spark, sf):
    return vehicles.normalise(frame(spark, sf, "labels_csv"))


@query("a1_read_label_csv", f"SELECT n, lib_mrq, nullif(lib_mod_doss, '') AS lib_mod_doss, dscom, puiss_max, nullif(conso_mixte, '') AS conso_mixte, cod_cbr FROM (SELECT CAST(n AS VARCHAR) AS n, nullif(lib_mrq, '') AS lib_mrq, lib_mod_doss, dscom, puiss_max, conso_mixte, cod_cbr FROM {S})")
def a1(spark, sf):
    path = files.scratch(spark, "labels")
    frame(spark, sf, "labels_csv").select("n", "lib_mrq", "lib_mod_doss", "dscom", "puiss_max", "conso_mixte", "cod_cbr").write.csv(path, header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_labels(spark, path)


def indented(spark, df, name, page, rows=5000):
    """A folder of indented JSON files, each a list of at most `rows` records, beside a broken one."""
    path = files.scratch(spark, name)
    pages = df.groupBy(F.floor(F.col(page) / rows).alias("page")).agg(F.collect_list(F.struct("*")).alias("r"))
    written = pages.select(F.to_json("r", {"pretty": "true"}).alias("value")).union(spark.createDataFrame([("[\n  {broken",)], "value string"))
    written.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("a2_read_nested_json", f"SELECT s_id, marque, len(string_split(pros, ';')) AS n_pros FROM {sql('sheets')}")
def a2(spark, sf):
    path = indented(spark, frame(spark, sf, "sheets").select("s_id", "marque", F.split("pros", ";").alias("qualites")), "sheets", "s_id")
    return records.read_documents(spark, path, "s_id: bigint, marque: string, qualites: array<string>").select("s_id", "marque", F.size("qualites").cast("long").alias("n_pros"))


@query("a2_read_json_lines", f"SELECT s_id, marque FROM {sql('sheets')}")
def a2_lines(spark, sf):
    path = files.scratch(spark, "sheets")
    df = frame(spark, sf, "sheets").select("s_id", "marque")
    df.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    return records.read_documents(spark, path, "s_id: bigint, marque: string")


@query("a3_transcode_listings", f"SELECT n, lib_mod_doss AS titre FROM {S}")
def a3(spark, sf):
    old, new = files.scratch(spark, "latin"), files.scratch(spark, "utf8")
    df = frame(spark, sf, "labels_csv").select("n", F.col("lib_mod_doss").alias("titre"))
    pages = df.groupBy(F.floor(F.col("n") / 5000).alias("page")).agg(F.collect_list(F.struct("*")).alias("annonces")).drop("page")
    pages.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("pretty", True).json(old)
    return records.transcode(spark, old, new, "n bigint, titre string", "annonces")


@query("a4_read_recall_pages", f"SELECT ref, product, risks FROM {sql('recalls')}")
def a4(spark, sf):
    path = files.scratch(spark, "recalls")
    pages = frame(spark, sf, "recalls").select("ref", "product", "risks").withColumn("page", F.floor(F.col("ref") / 5000))
    pages = pages.groupBy("page").agg(F.count("*").alias("total_count"), F.collect_list(F.struct("ref", "product", "risks")).alias("results"))
    pages.select(F.to_json(F.struct("total_count", "results"), {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return records.read_pages(spark, path, "ref: bigint, product: string, risks: string")


@query("a5_read_station_prices", f"SELECT station, name, raw FROM {sql('fuel_feed')}")
def a5(spark, sf):
    feed = frame(spark, sf, "fuel_feed")
    prices = F.array(F.struct(F.col("name").alias("@nom"), F.col("raw").alias("@valeur")))
    return records.read_stations(spark, indented(spark, feed.select("station", prices.alias("prix")), "stations", "station"))


@query("a6_column_aliases", f"SELECT n, lib_mrq AS marque, lib_mod_doss AS modele, '' AS code FROM {S}")
def a6(spark, sf):
    df = frame(spark, sf, "labels_csv")
    pick = lambda *names, default=None: files.first_column(df, list(names), default)
    return df.select("n", pick("Marque", "lib_mrq").alias("marque"), pick("lib_mod_doss", "lib_mod").alias("modele"), pick("Code TVV", default=F.lit("")).alias("code"))


CUR, INC = f"(SELECT vehicle_id, marque, prix FROM {sql('vehicles')} WHERE vehicle_id % 3 <> 0)", f"(SELECT vehicle_id, marque, prix * 2 AS prix FROM {sql('vehicles')} WHERE vehicle_id % 2 = 0)"
UPSERT = f"SELECT vehicle_id, coalesce(i.marque, c.marque) AS marque, coalesce(i.prix, c.prix) AS prix, CASE WHEN i.vehicle_id IS NULL THEN 'kept' WHEN c.vehicle_id IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM {CUR} c FULL JOIN {INC} i USING (vehicle_id)"


def upserted(spark, sf):
    v = frame(spark, sf, "vehicles").select("vehicle_id", "marque", "prix")
    return files.upsert(v.where("vehicle_id % 3 <> 0"), v.where("vehicle_id % 2 = 0").withColumn("prix", F.col("prix") * 2), ["vehicle_id"])


query("a7_upsert", UPSERT)(upserted)
query("a7_upsert_counts", f"SELECT change, count(*) AS n FROM ({UPSERT}) GROUP BY change")(lambda spark, sf: files.changes(upserted(spark, sf)))


MERGED = f"""SELECT vehicle_id, marque, CASE WHEN vehicle_id % 40 = 7 THEN prix * 3 WHEN vehicle_id % 2 = 0 THEN prix * 2 ELSE prix END AS prix
FROM {sql('vehicles')} WHERE vehicle_id % 3 <> 0 OR vehicle_id % 2 = 0 OR vehicle_id % 40 = 7"""


@query("a7_merge_buckets", MERGED)
def a7_merge(spark, sf):
    """A first load and two batches, each merged into the buckets that it touches; the last one runs twice, as after a failure."""
    v, path = frame(spark, sf, "vehicles").select("vehicle_id", "marque", "prix"), files.scratch(spark, "vehicles")
    buckets.create(spark, path, 16)
    times = lambda n, some: v.where(some).withColumn("prix", F.col("prix") * n)
    for version, rows in ((0, v.where("vehicle_id % 3 <> 0")), (1, times(2, "vehicle_id % 2 = 0")), (2, times(3, "vehicle_id % 40 = 7")), (2, times(3, "vehicle_id % 40 = 7"))):
        buckets.merge(rows, path, ["vehicle_id"], version)
    return buckets.read(spark, path, v.schema)


@query("a8_append", f"SELECT vehicle_id, count(*) AS n FROM (SELECT vehicle_id FROM {sql('vehicles')} UNION ALL SELECT vehicle_id FROM {sql('vehicles')} WHERE vehicle_id % 2 = 0) GROUP BY vehicle_id")
def a8(spark, sf):
    path, v = files.scratch(spark, "notes"), frame(spark, sf, "vehicles").select("vehicle_id")
    files.append(v, path)
    files.append(v.where("vehicle_id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("vehicle_id").agg(F.count("*").alias("n"))


@query("a9_report", f"SELECT '2024-03-01T12:30:00' AS scrape_date, 'caradisiac' AS source, (SELECT count(*) FROM {sql('reviews')}) AS total_reviews, level, count(*) AS n FROM {sql('reviews')} GROUP BY level")
def a9(spark, sf):
    rows = frame(spark, sf, "reviews").select("review_id", "level", "note")
    return files.report(rows, files.scratch(spark, "report"), "level", "caradisiac", F.lit("2024-03-01 12:30:00").cast("timestamp"))


@query("a10_count_objects", f"SELECT source, count(*) + 1 AS n FROM {sql('listings')} GROUP BY source")
def a10(spark, sf):
    """Exports of each source: lists of records, one object, a number, and a broken one."""
    lists = frame(spark, sf, "listings").groupBy("source", F.floor(F.col("k") / 1000).alias("page")).agg(F.to_json(F.collect_list(F.struct("external_id", "price"))).alias("export"))
    single = lists.select("source").distinct().select("source", F.explode(F.array(F.lit('{"a": 1}'), F.lit("17"), F.lit("[{"), F.lit("[]"))).alias("export"))
    return lists.select("source", "export").unionByName(single).groupBy("source").agg(F.sum(files.count_objects(F.col("export"))).cast("long").alias("n"))


query("a11_duplicate_keys", f"SELECT marque, modele, count(*) AS n FROM {sql('vehicles')} GROUP BY ALL HAVING count(*) > 1")(lambda spark, sf: files.duplicates(frame(spark, sf, "vehicles"), ["marque", "modele"]))
query("a11_duplicate_keys_sparse", f"SELECT author, date, count(*) AS n FROM {sql('reviews')} WHERE author IS NOT NULL AND date IS NOT NULL GROUP BY ALL HAVING count(*) > 1")(lambda spark, sf: files.duplicates(frame(spark, sf, "reviews"), ["author", "date"], sparse=True))

for name, columns in {
    "b1_brand_model": "n, marque, modele", "b2_decimal_comma": "n, conso, co2", "b3_power": "n, puissance", "b4_fuel_codes": "n, carburant", "b5_gearbox": "n, boite", "b6_year": "n, annee", "b7_text_limits": "n, motorisation, tvv",
}.items():
    query(name, f"SELECT {columns} FROM {NORMAL}")(lambda spark, sf, c=columns: normal(spark, sf).select(*c.split(", ")))
query("b3_fiscal_power", f"SELECT n, CAST(round_even(CAST(puiss_fisc AS DOUBLE) * 15, 0) AS INT) AS puissance FROM {S}")(lambda spark, sf: vehicles.normalise(frame(spark, sf, "labels_csv").drop("puiss_max")).select("n", "puissance"))
query("b8_composite_key", f"SELECT n, {KEY} AS cle FROM {NORMAL}")(lambda spark, sf: normal(spark, sf).select("n", "cle"))
query("b9_drop_invalid", f"SELECT n, marque, modele FROM {NORMAL} WHERE {VALID}")(lambda spark, sf: normal(spark, sf).where(vehicles.valid()).select("n", "marque", "modele"))
LOADED = f"SELECT n, marque, modele, CASE WHEN motorisation = '' THEN coalesce(CAST(puissance AS VARCHAR), '<NA>') || 'ch' ELSE motorisation END AS motorisation, coalesce(puissance, 100) AS puissance, carburant, conso, co2, boite, tvv, coalesce(annee, 2020) AS annee, {KEY} AS cle FROM {NORMAL} WHERE {VALID} QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY n) = 1"
query("w1_load_vehicles", LOADED)(lambda spark, sf: vehicles.load(frame(spark, sf, "labels_csv"), "n"))
query("b10_drop_empty_listings", f"SELECT n, lib_mod_doss FROM {S} WHERE lib_mod_doss <> '' OR lib_mod_doss IS NULL")(lambda spark, sf: frame(spark, sf, "labels_csv").select("n", "lib_mod_doss").where(~F.col("lib_mod_doss").eqNullSafe("")))


@query("b11_training_cleanup", f"SELECT n, CASE WHEN tvv2 = '' THEN '0' ELSE tvv2 END AS options, conso_mixte FROM (SELECT *, trim(tvv) AS tvv2 FROM {S}) WHERE tvv2 IS NOT NULL AND conso_mixte <> ''")
def b11(spark, sf):
    df = frame(spark, sf, "labels_csv").select("n", F.trim("tvv").alias("options"), "conso_mixte")
    df = df.withColumn("options", F.when(F.col("options") == "", "0").otherwise(F.col("options")))
    return df.select("n", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("options", "conso_mixte")]).dropna("any")


query("b12_unlabelled", f"SELECT review_id FROM {sql('reviews')} WHERE note IS NULL")(lambda spark, sf: frame(spark, sf, "reviews").where("note is null").select("review_id"))
query("b12_labelled", f"SELECT review_id, note FROM {sql('reviews')} WHERE note IS NOT NULL")(lambda spark, sf: frame(spark, sf, "reviews").where("note is not null").select("review_id", "note"))


#: Vehicles with rows that break each kind of rule.
FAULTY = ["vehicle_id", "CASE WHEN vehicle_id % 19 = 0 THEN '' ELSE marque END AS marque", "CASE WHEN vehicle_id % 23 = 0 THEN repeat(modele, 60) ELSE modele END AS modele", "designation AS motorisation",
    "CASE WHEN vehicle_id % 17 = 0 THEN NULL ELSE puissance * 9 - 500 END AS puissance", "carburant", "CASE WHEN vehicle_id % 29 = 0 THEN 'cvt' ELSE boite END AS boite", "annee_debut - 13 AS annee_debut", "annee_fin - 9 AS annee_fin",
    "CASE WHEN vehicle_id % 31 = 0 THEN repeat('M10', 9) ELSE 'M10' END AS tvv", "conso * 4 AS conso", "co2 * 3 AS co2"]
RULES = [
    ("marque", "length(marque) BETWEEN 1 AND 50"), ("modele", "length(modele) BETWEEN 1 AND 100"), ("motorisation", "length(motorisation) BETWEEN 1 AND 100"), ("puissance", "puissance IS NOT NULL AND puissance BETWEEN 50 AND 1500"),
    ("annee_debut", "annee_debut BETWEEN 1990 AND 2030"), ("annee_fin", "annee_fin BETWEEN 1990 AND 2030"), ("co2", "co2 BETWEEN 0 AND 500"), ("conso", "conso BETWEEN 0 AND 30"),
    ("carburant", "carburant IN ('essence', 'diesel', 'hybride', 'hybride_rechargeable', 'electrique', 'gpl', 'gnv', 'inconnu')"), ("boite", "boite IN ('manuelle', 'automatique', 'inconnu')"), ("tvv", "length(tvv) <= 20"), ("annees", "annee_fin >= annee_debut"),
]
CHECKED = "(SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in RULES) + f") AS broken FROM (SELECT {', '.join(FAULTY)} FROM {sql('vehicles')}))"


@query("b13_validate", f"SELECT vehicle_id, broken FROM {CHECKED}")
def b13(spark, sf):
    rows = frame(spark, sf, "vehicles").selectExpr(*FAULTY)
    return rows.select("vehicle_id", vehicles.violations(vehicles.vehicle_rules()).alias("broken"))


@query("b13_quarantine", f"SELECT vehicle_id, marque, puissance, broken FROM {CHECKED} WHERE broken <> ''")
def b13_quarantine(spark, sf):
    _, bad = vehicles.split_valid(frame(spark, sf, "vehicles").selectExpr(*FAULTY), vehicles.vehicle_rules())
    return bad.select("vehicle_id", "marque", "puissance", "broken")


@query("b13_valid", f"SELECT vehicle_id, marque, puissance FROM {CHECKED} WHERE broken = ''")
def b13_valid(spark, sf):
    good, _ = vehicles.split_valid(frame(spark, sf, "vehicles").selectExpr(*FAULTY), vehicles.vehicle_rules())
    return good.select("vehicle_id", "marque", "puissance")


LISTED = ["external_id", "k", "source AS title", "price - 2000 AS price", "km", "year - 5 AS year", "expert * 1.5 AS expert", "expert * 8 - 20 AS deal", "CASE WHEN k % 37 = 0 THEN '75001 Paris 1er' ELSE '75001' END AS zipcode"]
LISTING_RULES = [
    ("external_id", "length(external_id) >= 1"), ("title", "length(title) >= 1"), ("price", "price >= 0"), ("km", "km >= 0"), ("year", "year BETWEEN 1990 AND 2030"), ("expert", "expert BETWEEN 0 AND 20"), ("deal", "deal BETWEEN -100 AND 100"), ("zipcode", "length(zipcode) <= 10"),
]


@query("b13_validate_listings", "SELECT external_id, k, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in LISTING_RULES) + f") AS broken FROM (SELECT {', '.join(LISTED)} FROM {sql('listings')})")
def b13_listings(spark, sf):
    return frame(spark, sf, "listings").selectExpr(*LISTED).select("external_id", "k", vehicles.violations(vehicles.listing_rules()).alias("broken"))


LIST, VEH = sql("listings"), sql("vehicles")
B15 = f"""SELECT vehicle_id, CAST(floor(kw / 0.7355::DOUBLE) AS INT) AS ch FROM (SELECT *, CAST(floor(puissance * 0.7355::DOUBLE) AS INT) AS kw FROM {VEH})
WHERE lower(marque) LIKE '%peugeot%' AND abs(kw - CAST(floor(110 * 0.7355::DOUBLE) AS INT)) <= 7 AND carburant IN ('essence', 'hybride') ORDER BY vehicle_id LIMIT 50"""


@query("b15_label_rows", B15)
def b15(spark, sf):
    v = frame(spark, sf, "vehicles").withColumn("kw", F.floor(F.col("puissance") * filters.KW_PER_HP))
    return filters.label_rows(v, "vehicle_id", "Peugeot", None, 110, ["essence", "hybride"]).select("vehicle_id", "ch")


@query("b16_list_filter", f"SELECT vehicle_id FROM {VEH} WHERE starts_with(lower(marque), 're') AND regexp_matches(carburant, 'hybride|diesel')")
def b16(spark, sf):
    return frame(spark, sf, "vehicles").where(filters.vehicle_list("RE", ["hybride", "diesel"])).select("vehicle_id")


SEARCH_KEY = "replace(replace(lower(marque || modele), ' ', ''), '-', '')"


@query("b17_search_filter", f"SELECT vehicle_id FROM {VEH} WHERE starts_with(lower(marque), 'tesla') AND (contains({SEARCH_KEY}, 'model3') OR contains(lower(modele), 'model 3')) AND carburant = 'inconnu'")
def b17(spark, sf):
    return frame(spark, sf, "vehicles").where(filters.vehicle_search("Tesla", "Model 3", "inconnu")).select("vehicle_id")


@query("b17_free_query", f"SELECT vehicle_id FROM {VEH} WHERE starts_with(lower(marque), 'peugeot') AND (contains({SEARCH_KEY}, 'e208') OR contains(lower(modele), 'e-208')) AND regexp_matches(carburant, '(?i)diesel|GO|gazole')")
def b17_free(spark, sf):
    return frame(spark, sf, "vehicles").where(filters.vehicle_search(text="Peugeot e-208 occasion", fuel="diesel")).select("vehicle_id")


@query("b18_listing_filter", f"SELECT external_id FROM {LIST} WHERE price BETWEEN 10000 AND 40000 AND km <= 120000 AND year BETWEEN 2010 AND 2020 AND fuel = 'diesel' AND gearbox = 'manuelle' AND marque = 'Renault'")
def b18(spark, sf):
    wanted = filters.listing_filter((10000, 40000), 120000, (2010, 2020), "diesel", "manuelle", "Renault")
    return frame(spark, sf, "listings").where(wanted).select("external_id")


@query("b14_match_filter", f"SELECT vehicle_id FROM {VEH} WHERE lower(marque) = 'vw' AND contains(lower(modele), 'clio') AND puissance BETWEEN 100 AND 120 AND annee_debut <= 2013 AND (annee_fin IS NULL OR annee_fin >= 2011)")
def b14_filter(spark, sf):
    return frame(spark, sf, "vehicles").where(filters.vehicle_filter("VW", "CLIO", 110, "inconnu", "inconnu", 2012)).select("vehicle_id")


query("b19_minimum_score", f"SELECT external_id, expert FROM {LIST} WHERE expert >= 12")(lambda spark, sf: frame(spark, sf, "listings").where("expert >= 12").select("external_id", "expert"))
@query("b20_recall_search", f"SELECT ref FROM {sql('recalls')} WHERE category = 'automobiles' AND (contains(upper(coalesce(brand_field, '')), 'RENAULT') OR contains(upper(product), 'RENAULT')) AND contains(upper(product), 'CLIO')")
def b20(spark, sf):
    return frame(spark, sf, "recalls").where(filters.recall_search("Renault", "Clio")).select("ref")


query("b21_keep_reviews", f"SELECT review_id FROM {sql('reviews')} WHERE note IS NOT NULL OR fiabilite IS NOT NULL OR content <> ''")(lambda spark, sf: frame(spark, sf, "reviews").where("note is not null or fiabilite is not null or content <> ''").select("review_id"))


@query("b22_queue", f"SELECT review_id, CASE WHEN note IS NULL THEN 'failed' ELSE 'processed' END AS status, CASE WHEN note IS NULL THEN 'no rating' ELSE '' END AS errors FROM {sql('reviews')} WHERE level = 'low'")
def b22(spark, sf):
    rows = filters.queue(frame(spark, sf, "reviews"), F.col("level") == "low", F.when(F.col("note").isNull(), "no rating"), ["ts", "review_id"])
    return rows.select("review_id", "status", F.array_join("errors", ",").alias("errors"))


query("b23_fresh_snapshots", f"SELECT review_id FROM {sql('reviews')} WHERE ts + INTERVAL 300 SECOND >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00'")(
    lambda spark, sf: frame(spark, sf, "reviews").where("ts + make_dt_interval(0, 0, 0, 300) >= timestamp'2024-01-10 00:00:00' and ts <= timestamp'2024-01-10 00:00:00'").select("review_id")
)
query("b24_point_lookup", f"SELECT vehicle_id, marque, modele FROM {VEH} WHERE vehicle_id = 42")(lambda spark, sf: frame(spark, sf, "vehicles").where("vehicle_id = 42").select("vehicle_id", "marque", "modele"))
