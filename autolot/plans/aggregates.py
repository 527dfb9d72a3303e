"""Queries of aggregates, sorted pages and array operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from autolot.functions import cleaning as C
from autolot.functions import refdata as R
from autolot.functions import scores as Sc
from autolot.operators import learning, pages, rows, states, stats
from autolot.plans.lifts import frame, sql
from autolot.plans.matching import SEV
from autolot.plans.registry import query
from autolot.sources import buckets, files
from autolot.plans.sqltext import dbl, values

V, SH, LI, RE, RC, FU, IT = (sql(x) for x in ("vehicles", "sheets", "listings", "reviews", "recalls", "fuel_feed", "items"))

query("d1_verified_means", f"SELECT marque, modele, round(avg(fiabilite), 1) AS fiabilite, round(avg(confort), 1) AS confort, count(*) AS n FROM {RE} WHERE level IN ('high', 'medium') GROUP BY ALL HAVING count(*) >= 3")(lambda spark, sf: stats.verified_means(frame(spark, sf, "reviews"), ["marque", "modele"], ["fiabilite", "confort"]))
query("d2_distinct_brands", f"SELECT DISTINCT trim(marque) AS marque FROM {V} WHERE trim(marque) <> '' ORDER BY 1")(lambda spark, sf: frame(spark, sf, "vehicles").select(F.trim("marque").alias("marque")).where("marque <> ''").distinct().orderBy("marque"))
query("d3_has_more", f"SELECT count(*) AS total, 40 + least(20, greatest(0, count(*) - 40)) < count(*) AS has_more FROM {V} WHERE carburant = 'diesel'")(lambda spark, sf: frame(spark, sf, "vehicles").where("carburant = 'diesel'").agg(F.count("*").alias("total")).withColumn("has_more", F.lit(40) + F.least(F.lit(20), F.greatest(F.lit(0), F.col("total") - 40)) < F.col("total")))

STAT = dbl(f"(SELECT *, round(impact0, 2) AS impact, round(greatest(0, 10.0 - impact0), 2) AS score, round(greatest(0, least(10, 10.0 - critical * 2.0 - serious * 1.0 - moderate * 0.3)), 1) AS badge_score, CASE WHEN total = 0 THEN 0.0 WHEN total <= 2 THEN 0.5 * total WHEN total <= 5 THEN 1.0 + 0.3 * (total - 2) WHEN total <= 10 THEN 2.0 + 0.2 * (total - 5) ELSE 3.0 + 0.1 * (total - 10) END + 0.5 * penal AS penalty FROM (SELECT *, critical * 2.0 + serious * 1.0 + moderate * 0.5 AS impact0 FROM (SELECT *, critical + serious + moderate AS total FROM (SELECT KEYS, count_if(severity = 'critical') AS critical, count_if(severity = 'serious') AS serious, count_if(severity = 'moderate') AS moderate, count_if(penal) AS penal FROM {SEV} GROUP BY ALL))))")
MM, REF = STAT.replace("KEYS", "marque, modele"), STAT.replace("KEYS", "ref")
query("d4_recall_stats", f"SELECT marque, modele, total, critical, serious, moderate, impact, score FROM {MM}")(lambda spark, sf: stats.recall_stats(frame(spark, sf, "recalls"), ["marque", "modele"]).select("marque", "modele", "total", "critical", "serious", "moderate", "impact", "score"))
query("d4_vehicles_without_recalls", f"SELECT v.marque, v.modele, coalesce(score, 10.0::DOUBLE) AS score FROM (SELECT DISTINCT marque, modele FROM {V}) v LEFT JOIN (SELECT * FROM {MM}) s USING (marque, modele)")(
    lambda spark, sf: frame(spark, sf, "vehicles").select("marque", "modele").distinct().join(stats.recall_stats(frame(spark, sf, "recalls"), ["marque", "modele"]).select("marque", "modele", "score"), ["marque", "modele"], "left").withColumn("score", F.coalesce("score", F.lit(10.0)))
)
LEVEL = "CASE WHEN total = 0 THEN 'excellent' WHEN total <= 2 THEN 'bon' WHEN total <= 5 THEN 'moyen' WHEN total <= 10 THEN 'attention' ELSE 'critique' END"
WEEK = STAT.replace("KEYS", "marque, date_trunc('week', ts) AS week")
query("d5_recall_penalty", f"SELECT marque, week, round(greatest(0, least(10, 10.0::DOUBLE - penalty)), 1) AS score, round(penalty, 1) AS penalty, {LEVEL} AS level FROM {WEEK}")(
    lambda spark, sf: stats.recall_stats(frame(spark, sf, "recalls").withColumn("week", F.date_trunc("week", "ts")), ["marque", "week"]).select("marque", "week", F.round(Sc.clamp(10.0 - F.col("penalty")), 1).alias("score"), F.round("penalty", 1).alias("penalty"), Sc.recall_level(F.col("total")).alias("level"))
)
BADGE = "CASE WHEN {0} IS NULL THEN 'Non évalué' WHEN {0} >= 8.5 THEN 'Excellent' WHEN {0} >= 7 THEN 'Bon' WHEN {0} >= 5 THEN 'Moyen' WHEN {0} >= 3 THEN 'À éviter' ELSE 'Critique' END"
query("d6_recall_badge", f"SELECT marque, week, badge_score, {BADGE.format('badge_score')} AS badge FROM {WEEK}")(
    lambda spark, sf: stats.recall_stats(frame(spark, sf, "recalls").withColumn("week", F.date_trunc("week", "ts")), ["marque", "week"]).select("marque", "week", "badge_score", Sc.quality_label(F.col("badge_score")).alias("badge"))
)
NAMES = values([(n, f) for f, ns in R.STATION_NAMES.items() for n in ns], "m(name, fuel)")
DEF = values(list(R.STATION_DEFAULTS.items()), "d(fuel, usual)")
query("d7_fuel_prices", f"SELECT fuel, coalesce(mean, usual) AS mean, least, most, coalesce(stations, 0) AS stations FROM {DEF} LEFT JOIN (SELECT fuel, round(avg(p), 3) AS mean, round(min(p), 3) AS least, round(max(p), 3) AS most, count(*) AS stations FROM (SELECT fuel, try_cast(raw AS DOUBLE) / 1000 AS p FROM {FU} JOIN {NAMES} USING (name)) WHERE p IS NOT NULL GROUP BY fuel) USING (fuel)")(
    lambda spark, sf: stats.station_prices(frame(spark, sf, "fuel_feed"))
)


def sales():
    parts = F.filter(F.split("sales", ";"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("annee"), F.split(x, ":")[1].cast("int").alias("ventes")))


SALES = "list_transform(list_filter(string_split(sales, ';'), lambda x: x <> ''), lambda x: {'annee': CAST(string_split(x, ':')[1] AS INT), 'ventes': CAST(string_split(x, ':')[2] AS INT)})"
query("d8_total_sales", f"SELECT s_id, coalesce(list_sum(list_transform({SALES}, lambda x: x.ventes)), 0)::BIGINT AS total FROM {SH}")(lambda spark, sf: frame(spark, sf, "sheets").select("s_id", F.aggregate(sales(), F.lit(0).cast("long"), lambda a, x: a + x["ventes"]).alias("total")))
NOTES = "list_transform(list_filter(string_split(notes, ';'), lambda x: x <> ''), lambda x: CAST(x AS DOUBLE))"
notes = lambda: F.transform(F.filter(F.split("notes", ";"), lambda x: x != ""), lambda x: x.cast("double"))
query("d9_mean_engine_note", f"SELECT s_id, list_avg({NOTES}) AS mean FROM {SH}")(lambda spark, sf: frame(spark, sf, "sheets").withColumn("x", notes()).select("s_id", F.try_divide(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), F.size("x")).alias("mean")))
query("d11_capture_summary", f"SELECT level, count(*) AS n, count(DISTINCT marque || modele) AS models FROM {RE} GROUP BY level")(lambda spark, sf: frame(spark, sf, "reviews").groupBy("level").agg(F.count("*").alias("n"), F.count_distinct(F.concat("marque", "modele")).alias("models")))
D12 = f"""SELECT marque, modele, count(*) AS n, round(avg(fiabilite), 6) AS fiabilite, round(stddev_samp(fiabilite), 6) AS fiabilite_sd, round(avg(note), 6) AS note, round(stddev_samp(note), 6) AS note_sd,
 round(avg(confort), 6) AS confort, round(avg(km), 6) AS km, coalesce(any_value(rappels), 0) AS rappels
FROM {RE} LEFT JOIN (SELECT marque, modele, count(*) AS rappels FROM {RC} GROUP BY ALL) USING (marque, modele) GROUP BY ALL"""


@query("d12_vehicle_stats", D12)
def d12(spark, sf):
    return stats.vehicle_stats(frame(spark, sf, "reviews"), frame(spark, sf, "recalls"), ["marque", "modele"], ["fiabilite", "note"], ["confort", "km"])


D12_MERGED = D12.replace(", coalesce(any_value(rappels), 0) AS rappels", "").replace(f" LEFT JOIN (SELECT marque, modele, count(*) AS rappels FROM {RC} GROUP BY ALL) USING (marque, modele)", " WHERE review_id % 11 <> 0")


@query("d12_merged_stats", D12_MERGED)
def d12_merged(spark, sf):
    """Three days of reviews folded into states one after another; on the fourth, reviews of the first ones are taken back. The third day's batch runs twice."""
    keys, columns = ["marque", "modele"], ["fiabilite", "note", "confort", "km"]
    reviews, path = frame(spark, sf, "reviews"), files.scratch(spark, "states")
    buckets.create(spark, path, 16)
    for version, day in ((0, 0), (1, 1), (2, 2), (2, 2)):
        states.fold(states.state(reviews.where(F.col("review_id") % 3 == day), keys, columns), path, keys, version)
    back = states.state(reviews.where("review_id % 11 = 0"), keys, columns, -1)
    states.fold(back, path, keys, 3)
    return states.statistics(buckets.read(spark, path, back.schema), keys, ["fiabilite", "note"], ["confort", "km"])


query("d12_top_points", f"SELECT marque, string_agg(p, ';' ORDER BY n DESC, p) AS top FROM (SELECT marque, p, count(*) AS n FROM (SELECT lower(marque) AS marque, unnest(string_split(pros, ';')) AS p FROM {SH}) WHERE p <> '' GROUP BY marque, p QUALIFY row_number() OVER (PARTITION BY marque ORDER BY count(*) DESC, p) <= 5) GROUP BY marque")(
    lambda spark, sf: stats.top_words(frame(spark, sf, "sheets").select(F.lower("marque").alias("marque"), F.explode(F.split("pros", ";")).alias("p")).where("p <> ''"), ["marque"], "p", 5)
)
query("d12_fault_shares", f"SELECT marque, modele, round(sum(engine_faults) / sum(faults), 6) AS engine, round(sum(gearbox_faults) / sum(faults), 6) AS gearbox FROM {SH} GROUP BY ALL HAVING sum(faults) > 0")(
    lambda spark, sf: frame(spark, sf, "sheets").groupBy("marque", "modele").agg(F.sum("faults").alias("n"), F.sum("engine_faults").alias("e"), F.sum("gearbox_faults").alias("g")).where("n > 0").select("marque", "modele", F.round(F.col("e") / F.col("n"), 6).alias("engine"), F.round(F.col("g") / F.col("n"), 6).alias("gearbox"))
)
KIND = "CASE WHEN {0} IS NULL THEN 'estimated' WHEN {0} > 5 THEN 'official' ELSE 'verified_scrape' END"
query("d13_data_quality", f"SELECT review_id, CASE WHEN good = 3 THEN 'high' WHEN good >= 1.5 THEN 'medium' ELSE 'low' END AS quality FROM (SELECT review_id, (fiabilite IS NOT NULL)::INT + (confort IS NOT NULL)::INT + (note IS NOT NULL)::INT AS good FROM {RE})")(
    lambda spark, sf: frame(spark, sf, "reviews").select("review_id", stats.quality_of_sources(F.array(*[F.when(F.col(c).isNull(), "estimated").when(F.col(c) > 5, "official").otherwise("verified_scrape") for c in ("fiabilite", "confort", "note")])).alias("quality"))
)
query("d14_regression_metrics", f"SELECT round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(1 - mse / v, 6) AS r2 FROM (SELECT avg((note - 2 * fiabilite) ** 2) AS mse, avg(abs(note - 2 * fiabilite)) AS mae, var_pop(note) AS v FROM {RE} WHERE note IS NOT NULL AND fiabilite IS NOT NULL)")(
    lambda spark, sf: stats.regression_metrics(frame(spark, sf, "reviews").where("note is not null and fiabilite is not null").withColumn("p", F.col("fiabilite") * 2), "note", "p").select(*[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "r2")])
)
query("d16_sources_used", f"SELECT review_id, concat_ws(',', CASE WHEN fiabilite IS NOT NULL THEN 'avis' END, CASE WHEN confort IS NOT NULL THEN 'fiche' END, CASE WHEN note IS NOT NULL THEN 'ademe' END) AS sources, ((fiabilite IS NOT NULL)::INT + (confort IS NOT NULL)::INT + (note IS NOT NULL)::INT) AS n FROM {RE}")(
    lambda spark, sf: frame(spark, sf, "reviews").withColumn("s", F.filter(F.array(F.when(F.col("fiabilite").isNotNull(), "avis"), F.when(F.col("confort").isNotNull(), "fiche"), F.when(F.col("note").isNotNull(), "ademe")), lambda x: x.isNotNull())).select("review_id", F.array_join("s", ",").alias("sources"), F.size("s").alias("n"))
)

query("f1_best_page", f"SELECT vehicle_id, prix FROM {V} ORDER BY prix DESC, vehicle_id LIMIT 20 OFFSET 40")(lambda spark, sf: rows.page(frame(spark, sf, "vehicles").select("vehicle_id", "prix"), [F.desc("prix"), F.col("vehicle_id")], 40, 20))


@query("f1_page_of_directory", f"SELECT vehicle_id, marque, modele, prix FROM {V} ORDER BY prix DESC, vehicle_id LIMIT 20 OFFSET 130")
def f1_directory(spark, sf):
    """A page in the middle, from a table that is sorted once in ranges."""
    order, path = [F.desc("prix"), F.col("vehicle_id")], files.scratch(spark, "pages")
    pages.write(frame(spark, sf, "vehicles").select("vehicle_id", "marque", "modele", "prix"), path, order, 50)
    return pages.page(spark, path, order, 130, 20)


query("f1_page_after", f"SELECT vehicle_id, prix FROM {V} WHERE prix < 9500 OR (prix = 9500 AND vehicle_id > 10) ORDER BY prix DESC, vehicle_id LIMIT 20")(lambda spark, sf: rows.page_after(frame(spark, sf, "vehicles").select("vehicle_id", "prix"), "prix", "vehicle_id", (9500.0, 10), 20))
query("f2_search_top", f"SELECT s_id, score, array_to_string(string_split(pros, ';')[1:3], ';') AS pros FROM {SH} WHERE lower(modele) LIKE '%golf%' ORDER BY score DESC NULLS LAST, s_id LIMIT 30")(lambda spark, sf: frame(spark, sf, "sheets").where(F.lower("modele").contains("golf")).orderBy(F.desc_nulls_last("score"), "s_id").limit(30).select("s_id", "score", F.array_join(F.slice(F.split("pros", ";"), 1, 3), ";").alias("pros")))
query("f3_listing_order", f"SELECT external_id, k FROM {LI} ORDER BY coalesce(expert, 0) DESC, coalesce(price, 999999), external_id, k")(lambda spark, sf: frame(spark, sf, "listings").orderBy(F.coalesce("expert", F.lit(0.0)).desc(), F.coalesce("price", F.lit(999999.0)), "external_id", "k").select("external_id", "k"))
query("f4_recalls_of_vehicle", f"SELECT marque, modele, ref FROM {RC} QUALIFY row_number() OVER (PARTITION BY marque, modele ORDER BY ref) <= 10")(lambda spark, sf: rows.cap(frame(spark, sf, "recalls").select("marque", "modele", "ref"), ["marque", "modele"], ["ref"], 10))
query("f5_first_items", f"SELECT s_id, array_to_string(string_split(pros, ';')[1:2], ';') AS pros, len(string_split(pros, ';')[1:2])::INT AS n FROM {SH}")(lambda spark, sf: frame(spark, sf, "sheets").withColumn("p", F.slice(F.split("pros", ";"), 1, 2)).select("s_id", F.array_join("p", ";").alias("pros"), F.size("p").alias("n")))
query("f6_sales_by_year", f"SELECT s_id, array_to_string(list_transform(list_sort({SALES}), lambda x: CAST(x.annee AS VARCHAR)), ',') AS years FROM {SH}")(lambda spark, sf: frame(spark, sf, "sheets").select("s_id", F.array_join(F.transform(F.sort_array(sales()), lambda x: x["annee"].cast("string")), ",").alias("years")))


def merge_points(expert, user):
    """Expert points, then users', without those that begin as one before, short ones and ones in brackets; at most 25."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.concat(expert, user), none, lambda a, x: F.when(F.exists(a, lambda y: F.substring(y, 1, 100) == F.substring(x, 1, 100)), a).otherwise(F.array_append(a, x)))
    return F.slice(F.filter(kept, lambda x: (F.length(x) > 15) & ~F.startswith(x, F.lit("("))), 1, 25)


@query("g2_merge_points", f"SELECT s_id, string_agg(x, ';' ORDER BY p) AS points FROM (SELECT s_id, x, min(p) AS p FROM (SELECT s_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT s_id, string_split(pros || ';' || cons || ';' || pros, ';') AS l FROM {SH})) WHERE length(x) > 15 AND NOT starts_with(x, '(') GROUP BY ALL) GROUP BY s_id")
def g2(spark, sf):
    df = frame(spark, sf, "sheets").select("s_id", F.split(F.concat_ws(";", "pros", "cons"), ";").alias("a"), F.split("pros", ";").alias("b"))
    return df.select("s_id", F.array_join(merge_points(F.col("a"), F.col("b")), ";").alias("points")).where("points <> ''")


@query("g3_train_test_split", f"SELECT review_id, CASE WHEN ('0x' || md5('42|' || review_id)[1:8])::BIGINT % 10 < 8 THEN 'train' ELSE 'test' END AS part FROM {RE}")
def g3(spark, sf):
    """80 / 20 by a hash of the key."""
    return frame(spark, sf, "reviews").select("review_id", F.when(learning.bucket("review_id") < 8, "train").otherwise("test").alias("part"))


STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"
KW = f"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[{C.LETTERS}]{{{{3,}}}}')), lambda w: NOT list_contains({STOP}, w))"
query("g4_keyword_overlap", f"SELECT n, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS rest FROM (SELECT n, {KW.format('item')} AS a, {KW.format(repr('le coffre est grand et la route est bonne'))} AS b FROM {IT})")(
    lambda spark, sf: frame(spark, sf, "items").withColumns({"a": C.keywords(F.col("item")), "b": C.keywords(F.lit("le coffre est grand et la route est bonne"))}).select("n", F.array_join(F.sort_array(F.array_intersect("a", "b")), ",").alias("shared"), F.array_join(F.sort_array(F.array_except("a", "b")), ",").alias("rest"))
)
