"""Queries of text normalisation, extraction, page parsing and review cleaning."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from autolot.functions import cleaning as C
from autolot.functions import parsing as P
from autolot.functions import refdata as R
from autolot.functions import text as T
from autolot.operators import filters
from autolot.operators.matching import feature_match
from autolot.plans.aggregates import KW as KEYWORDS
from autolot.plans.lifts import BRANDS, frame, sql
from autolot.plans.matching import MODEL
from autolot.operators.rows import dealt, different
from autolot.plans.registry import query
from autolot.plans.sqltext import brand, dbl, has, norm
from autolot.sources.files import materialize

V, SH, LI, RE, RC, IT, TI, CSV = (sql(x) for x in ("vehicles", "sheets", "listings", "reviews", "recalls", "items", "titles", "labels_csv"))


def simple(name: str, table: str, ident: str, column: str, expression, sql_expression: str) -> None:
    """A query of one column beside the key."""
    query(name, f"SELECT {ident}, {sql_expression} AS {column} FROM {sql(table)}")(lambda spark, sf: frame(spark, sf, table).select(ident, expression().alias(column)))


simple("h1_normalize", "vehicles", "vehicle_id", "text", lambda: T.normalize(F.concat_ws("_", "marque", "designation")), norm("marque || '_' || designation"))
simple("h2_normalize_brand", "vehicles", "vehicle_id", "brand", lambda: T.normalize_brand(F.col("marque")), brand("marque"))
query("h3_model_of_designation", f"SELECT vehicle_id, {MODEL} AS model FROM (SELECT vehicle_id, upper(trim(designation)) AS d FROM {V})")(lambda spark, sf: frame(spark, sf, "vehicles").select("vehicle_id", T.model_of_designation(F.col("designation"), F.col("marque")).alias("model")))
simple("h4_match_key", "vehicles", "vehicle_id", "key", lambda: T.model_key(F.col("marque"), F.col("modele")), f"{brand('marque')} || '_' || {norm('modele')}")

TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(title), 'éèêëàâäîïôöùûüç', 'eeeeaaaiioouuuc'), '[/\-_,;:()\[\]]+', ' ', 'g'), '\s+', ' ', 'g'), '[^\w\s.]', ' ', 'g'))"
TITLES = f"(SELECT title, {TEXT} AS t FROM (SELECT DISTINCT title FROM {TI}))"
titles = lambda spark, sf: different(frame(spark, sf, "titles"), "title").withColumn("t", T.listing_text(F.col("title")))
word = lambda ws: r"\b(" + "|".join(re.escape(w) for w in ws).replace("'", "''") + r")\b"
BRAND = "CASE " + " ".join(f"WHEN regexp_matches(t, '{word(a)}') THEN '{b.title()}'" for b, a in R.BRANDS.items()) + " END"
BRAND = BRAND.replace(r"\ ", " ").replace(r"\-", "-")
POWERS = "list_filter(list_transform(" + " || ".join(f"regexp_extract_all(t, '{p}', 1)" for p in R.POWER_PATTERNS) + ", lambda x: CAST(x AS INT)), lambda x: x BETWEEN 50 AND 800)"
COUNT = lambda ws: " + ".join(rf"len(regexp_extract_all(t, '\b{w}\b'))" for w in ws)
FUEL = "CASE " + " ".join(r"WHEN regexp_matches(t, '(^|\s|-)(" + "|".join(w.replace(".", r"\.") for w in ws) + rf")(\s|$|-)') THEN '{f}'" for f, ws in R.FUEL_WORDS.items()) + " ELSE 'inconnu' END"
GEAR = f"CASE WHEN {COUNT(R.GEARBOX_WORDS['automatique'])} > {COUNT(R.GEARBOX_WORDS['manuelle'])} THEN 'automatique' WHEN {COUNT(R.GEARBOX_WORDS['manuelle'])} > {COUNT(R.GEARBOX_WORDS['automatique'])} THEN 'manuelle' ELSE 'inconnu' END"
YEAR = r"list_filter(list_transform(regexp_extract_all(t, '\b(20[0-2][0-9])\b', 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 2000 AND 2026)[1]"
MODE = "(SELECT v FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS p) GROUP BY v ORDER BY count(*) DESC, min(p) LIMIT 1)"
query("h5_listing_text", f"SELECT title, t FROM {TITLES}")(titles)
query("h6_brand_in_title", f"SELECT title, {BRAND} AS brand FROM {TITLES}")(lambda spark, sf: titles(spark, sf).select("title", T.brand_in(F.col("t")).alias("brand")))
NEXT = "CASE " + " ".join(f"WHEN brand = '{b.title()}' THEN coalesce(" + ", ".join(rf"CASE WHEN length(regexp_extract(title, '(?i)\b{a}\s+([a-zA-Z0-9\-]+)', 1)) >= 2 THEN upper(regexp_extract(title, '(?i)\b{a}\s+([a-zA-Z0-9\-]+)', 1)) END" for a in al) + ")" for b, al in R.BRANDS.items()) + " END"
query("h7_model_in_title", f"SELECT title, {NEXT} AS model FROM (SELECT *, {BRAND} AS brand FROM {TITLES})")(lambda spark, sf: titles(spark, sf).withColumn("brand", T.brand_in(F.col("t"))).select("title", T.model_in(F.col("title"), F.col("brand")).alias("model")))
query("h8_power_in_title", f"SELECT title, {MODE} AS power FROM (SELECT title, {POWERS} AS l FROM {TITLES})")(lambda spark, sf: titles(spark, sf).select("title", T.power_in(F.col("t")).alias("power")))
query("h9_year_in_title", f"SELECT title, {YEAR} AS year FROM {TITLES}")(lambda spark, sf: titles(spark, sf).select("title", T.year_in(F.col("t")).alias("year")))
query("h10_gearbox_in_title", f"SELECT title, {GEAR} AS gearbox FROM {TITLES}")(lambda spark, sf: titles(spark, sf).select("title", T.gearbox_in(F.col("t")).alias("gearbox")))
query("h11_fuel_in_title", f"SELECT title, {FUEL} AS fuel FROM {TITLES}")(lambda spark, sf: titles(spark, sf).select("title", T.fuel_in(F.col("t")).alias("fuel")))
FEATURES = f"(SELECT title, t, {MODE} AS power, {YEAR} AS year, {GEAR} AS gearbox, {FUEL} AS fuel, {BRAND} AS brand FROM (SELECT *, {POWERS} AS l FROM {TITLES}))"
query("h12_features", f"SELECT title, power, year, gearbox, fuel, t[1:200] AS text, power IS NOT NULL AND year IS NOT NULL AND gearbox <> 'inconnu' AND fuel <> 'inconnu' AS complete FROM {FEATURES}")(lambda spark, sf: different(frame(spark, sf, "titles"), "title").select("title", T.features(F.col("title")).alias("f")).select("title", "f.*"))
query("d15_power_candidates", f"SELECT title, array_to_string({POWERS}, ',') AS candidates, {MODE} AS best FROM (SELECT *, {POWERS} AS l FROM {TITLES})")(lambda spark, sf: titles(spark, sf).withColumn("c", T.power_candidates(F.col("t"))).select("title", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("candidates"), T.most_frequent(F.col("c")).alias("best")))
FLAGS = [("brand IS NOT NULL", 1.0), ("model IS NOT NULL", 0.9), ("power IS NOT NULL", 1.0), ("fuel <> 'inconnu'", 1.0), ("gearbox <> 'inconnu'", 0.8), ("year IS NOT NULL", 1.0)]
CONF = "round((" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for c, w in FLAGS) + ") / greatest(1, " + " + ".join(f"({c})::INT" for c, _ in FLAGS) + "), 2)"
NAMED = f"(SELECT *, {NEXT} AS model FROM {FEATURES})"


def named(spark, sf):
    """Different titles with brand, model and the struct of features `f`."""
    df = titles(spark, sf).withColumns({"brand": T.brand_in(F.col("t")), "f": T.features(F.col("title"))})
    return df.withColumn("model", T.model_in(F.col("title"), F.col("brand")))


@query("b14_match_confidence", dbl(f"SELECT title, {CONF} AS confidence, CASE WHEN power IS NOT NULL AND year IS NOT NULL AND gearbox <> 'inconnu' AND fuel <> 'inconnu' THEN 'full' ELSE 'partial' END AS completeness FROM {NAMED}"))
def b14(spark, sf):
    c = F.col
    sure = filters.confidence(c("brand"), c("model"), c("f.power"), c("f.fuel"), c("f.gearbox"), c("f.year"))
    return named(spark, sf).select("title", sure.alias("confidence"), F.when(c("f.complete"), "full").otherwise("partial").alias("completeness"))


C7 = f"""WITH q AS (SELECT title, brand, model, power, fuel FROM {NAMED}), d AS (SELECT DISTINCT brand, model, power, fuel FROM q),
h AS (SELECT d.*, min(vehicle_id) AS vehicle_id FROM d JOIN {V} v ON (brand IS NULL OR lower(marque) = lower(brand)) AND (model IS NULL OR contains(lower(modele), lower(model)))
 AND (power IS NULL OR puissance BETWEEN power - 10 AND power + 10) AND (fuel = 'inconnu' OR carburant = fuel) GROUP BY ALL)
SELECT title, vehicle_id, CASE WHEN vehicle_id IS NULL THEN 'fallback_power_based' ELSE 'exact' END AS match_type FROM q LEFT JOIN h
 ON q.brand IS NOT DISTINCT FROM h.brand AND q.model IS NOT DISTINCT FROM h.model AND q.power IS NOT DISTINCT FROM h.power AND q.fuel = h.fuel"""


@query("c7_feature_match", C7)
def c7(spark, sf):
    """Titles with the vehicle that their brand, model, power and fuel lead to."""
    q = titles(spark, sf).select("title", T.brand_in(F.col("t")).alias("brand"), T.power_in(F.col("t")).alias("power"), T.fuel_in(F.col("t")).alias("fuel"))
    q = materialize(q.select("title", "brand", T.model_in(F.col("title"), F.col("brand")).alias("model"), "power", "fuel"), "features")
    found = feature_match(q, frame(spark, sf, "vehicles"), "vehicle_id").toDF("_b", "_m", "_p", "_f", "vehicle_id", "match_type")
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("brand", "_b"), ("model", "_m"), ("power", "_p"), ("fuel", "_f"))]
    return q.join(found, reduce(and_, on)).select("title", "vehicle_id", "match_type")


simple("h13_repair", "vehicles", "vehicle_id", "text", lambda: T.repair(F.concat(F.lit("VÃ©hicule Ã  "), "marque", F.lit(" 100â‚¬Â"))), "'Véhicule à ' || marque || ' 100€'")
query("h14_clean_numbers", f"SELECT external_id, k, CAST(CAST(round(price) AS BIGINT) AS INT) AS prix, CAST(km AS INT) AS km, CASE WHEN year % 2 = 0 THEN year END AS annee FROM {LI}")(
    lambda spark, sf: frame(spark, sf, "listings").select("external_id", "k", T.digits(F.format_string("%,d €", F.round("price").cast("long"))).alias("prix"), T.digits(F.concat(F.col("km").cast("int").cast("string"), F.lit(" km"))).alias("km"), T.year_of(F.when(F.col("year") % 2 == 0, F.concat(F.lit("mise en circulation 01/"), F.col("year").cast("string"))).otherwise("inconnue")).alias("annee"))
)
NUM = r"CAST(replace(nullif(regexp_extract(text, '(\d+(?:[.,]\d+)?)', 1), ''), ',', '.') AS DOUBLE)"
FR = r"regexp_extract(text, '(\d+(?:[.,]\d+)?)\s*/\s*(\d+)', {})"
query("h15_rating", f"SELECT review_id, CASE WHEN x IS NOT NULL THEN round(x / nullif(y, 0) * 10, 1) WHEN v <= 5 THEN round(v * 2, 1) WHEN v <= 10 THEN round(v, 1) WHEN v <= 20 THEN round(v / 2, 1) END AS rating FROM (SELECT review_id, {NUM} AS v, try_cast(replace({FR.format(1)}, ',', '.') AS DOUBLE) AS x, try_cast({FR.format(2)} AS DOUBLE) AS y FROM {RE})")(
    lambda spark, sf: frame(spark, sf, "reviews").select("review_id", T.rating(F.col("text")).alias("rating"))
)
query("h16_suffixed_number", f"SELECT vehicle_id, CASE vehicle_id % 3 WHEN 0 THEN puissance * 1000 WHEN 1 THEN puissance * 100000 ELSE puissance END::BIGINT AS n FROM {V}")(
    lambda spark, sf: frame(spark, sf, "vehicles").withColumn("p", F.col("puissance").cast("string")).select("vehicle_id", T.suffixed_number(F.when(F.col("vehicle_id") % 3 == 0, F.concat("p", F.lit(" k"))).when(F.col("vehicle_id") % 3 == 1, F.concat((F.col("puissance") / 10).cast("string"), F.lit("M"))).otherwise(F.concat("p", F.lit(" ventes")))).alias("n"))
)
simple("h17_pseudonym", "reviews", "review_id", "author", lambda: T.pseudonym(F.col("author")), "CASE WHEN trim(coalesce(author, '')) = '' THEN 'anonymous' ELSE sha256(trim(author))[1:16] END")
query("h18_criteria", f"SELECT marque, round(avg(CASE WHEN label = 'Fiabilité' THEN note END), 6) AS fiabilite, round(avg(CASE WHEN label = 'Confort' THEN note END), 6) AS confort, round(avg(CASE WHEN label = 'volume de coffre' THEN note END), 6) AS habitabilite_interieur FROM {RE} WHERE label <> 'Prix' GROUP BY marque")(
    lambda spark, sf: frame(spark, sf, "reviews").withColumn("c", T.lookup(R.CRITERIA, F.lower(F.trim("label")))).where("c is not null").groupBy("marque").pivot("c", ["fiabilite", "confort", "habitabilite_interieur"]).agg(F.round(F.avg("note"), 6))
)
query("h19_scores_to_ten", f"SELECT r_id, round(fiabilite * 2, 1) AS fiabilite, round(confort * 2, 1) AS confort FROM {sql('model_reviews')}")(lambda spark, sf: frame(spark, sf, "model_reviews").withColumn("m", F.transform_values(F.create_map(F.lit("f"), "fiabilite", F.lit("c"), "confort"), lambda k, v: F.round(v * 2, 1))).select("r_id", F.col("m")["f"].alias("fiabilite"), F.col("m")["c"].alias("confort")))

# Pages: the text of captured reviews, sheets and cards is put together from lifted columns, then parsed.
query("h20_review_page", f"SELECT r_id, confort, securite, nb_avis FROM {sql('model_reviews')}")(
    lambda spark, sf: frame(spark, sf, "model_reviews").withColumn("html", F.concat(F.lit("<b>Avis</b> <p>Confort : "), F.col("confort").cast("string"), F.lit("/5</p><div>Sécurité <i>"), F.coalesce(F.col("securite").cast("string"), F.lit("-")), F.lit("/5</i></div> "), F.col("nb_avis").cast("string"), F.lit(" avis"))).select("r_id", P.page_score(F.col("html"), "Confort").alias("confort"), P.page_score(F.col("html"), "Sécurité").alias("securite"), P.page_reviews(F.col("html")).alias("nb_avis"))
)
BLOCK = """
concat(CAST(coalesce(note, 0) AS STRING), '/5\nBonne voiture ', modele, CASE WHEN review_id % 2 = 0 THEN '\nJanvier 2021' ELSE '' END, '\nRédigé par ', coalesce(nullif(trim(author), ''), 'Paul'), ', en mars 2023\nFévrier 2022\n',
  CASE WHEN review_id % 3 = 0 THEN 'diesel' ELSE 'Essence' END, '\nmanuelle\n1.2L - ', CAST(60 + n_pros AS STRING), ' ch\nAvantages :\nconfort\n', CASE WHEN review_id % 5 = 0 THEN 'silence' ELSE 'coffre' END, '\nInconvénients :\nbruit\nprix élevé')
"""
BLOCK_SQL = """
SELECT review_id, coalesce(note, 0)::DOUBLE AS note, sha256(coalesce(nullif(trim(author), ''), 'Paul'))[1:16] AS author, 'mars 2023' AS date, CASE WHEN review_id % 2 = 0 THEN 'Janvier 2021' ELSE 'mars 2023' END AS vehicle_month,
  CASE WHEN review_id % 3 = 0 THEN 'Diesel' ELSE 'Essence' END AS fuel, 'Manuelle' AS gearbox, '1.2L - ' || (60 + n_pros) || ' ch' AS engine, CASE WHEN review_id % 5 = 0 THEN NULL ELSE 'confort' || chr(10) || 'coffre' END AS pros,
  'bruit' || chr(10) || 'prix élevé' AS cons, 'Bonne voiture ' || modele AS title FROM
"""


@query("h21_review_block", BLOCK_SQL + RE)
def h21(spark, sf):
    return frame(spark, sf, "reviews").select("review_id", P.block(F.expr(BLOCK)).alias("b")).select("review_id", "b.*")


query("h22_sheet_links", f"SELECT s_id, CAST(2000 + s_id % 20 AS INT) AS first, CASE WHEN s_id % 2 = 0 THEN CAST(2005 + s_id % 20 AS INT) END AS last, {norm('marque')} AS marque, 2 AS links FROM {SH}")(
    lambda spark, sf: frame(spark, sf, "sheets").withColumns({"url": F.concat(F.lit("/fiche/"), F.replace(T.normalize(F.col("marque")), F.lit(" "), F.lit("+")), F.lit("/x-12.html")), "html": F.concat(F.lit("<h1>X ("), (2000 + F.col("s_id") % 20).cast("string"), F.lit("-"), F.when(F.col("s_id") % 2 == 0, (2005 + F.col("s_id") % 20).cast("string")).otherwise(""), F.lit(')</h1><a href="/fiche/a/b-12.html">a</a><a href="/fiche/a/c-77.html">c</a><a href="/autre">d</a>'))}).select("s_id", P.period(F.col("html")).alias("p"), F.replace(P.url_part(F.col("url"), 1), F.lit("+"), F.lit(" ")).alias("marque"), F.size(P.sheet_links(F.col("html"))).alias("links")).select("s_id", "p.first", "p.last", "marque", "links")
)
SAID = " selon la rédaction, après un long essai sur route"


def section(points):
    """A section's HTML: an engine, the experts' words, then the users'."""
    point = lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))
    some = F.filter(F.split(points, ";"), lambda x: x != "")
    experts = F.array_join(F.transform(some, lambda x: point(F.concat(x, F.lit(SAID)))), "")
    users = F.array_join(F.transform(some, point), "")
    skipped = F.lit("<p>12 défauts signalés par les internautes</p><p>Toutes les autres fiches de la marque</p>")
    return F.concat(F.lit("<p>(1.2 PureTech 110 ch, depuis 2014)</p>"), experts, F.lit("<b>L'avis des internautes</b>"), users, skipped)


POINT = "array_to_string(list_transform(list_filter(string_split({0}, ';'), lambda x: x <> ''), lambda x: x || '" + SAID + "'), ';') AS {0}_expert, array_to_string(list_filter(string_split({0}, ';'), lambda x: length(x) > 15), ';') AS {0}_user"


@query("h23_sheet_points", f"SELECT s_id, {POINT.format('pros')}, {POINT.format('cons')} FROM {SH}")
def h23(spark, sf):
    html = F.concat(F.lit("<h2>Qualités</h2>"), section("pros"), F.lit("<h2>Défauts</h2>"), section("cons"))
    parts = ("pros_expert", "pros_user", "cons_expert", "cons_user")
    return dealt(frame(spark, sf, "sheets").select("s_id", "pros", "cons"), "s_id").select("s_id", P.sheet_points(html).alias("p")).select("s_id", *(F.array_join(f"p.{c}", ";").alias(c) for c in parts))


SOLD = "list_sort(list_transform(list_filter(string_split(sales, ';'), lambda x: x <> ''), lambda x: x))"


@query("h24_yearly_sales", f"SELECT s_id, CASE WHEN len({SOLD}) >= 3 THEN array_to_string({SOLD}, ';') ELSE '' END AS sales FROM {SH}")
def h24_sales(spark, sf):
    """Tables with a row of years and one of numbers, those of a thousand or more written in thousands."""
    some = F.filter(F.split("sales", ";"), lambda x: x != "")
    row = lambda of: F.concat(F.lit("<tr><th>-</th>"), F.array_join(F.transform(some, lambda x: F.concat(F.lit("<td>"), of(x), F.lit("</td>"))), ""), F.lit("</tr>"))
    sold = lambda x: F.split(x, ":")[1].cast("int")
    short = lambda x: F.when(sold(x) >= 1000, F.concat((sold(x) / 1000).cast("string"), F.lit("K"))).otherwise(sold(x).cast("string"))
    html = F.concat(F.lit("<table>"), row(lambda x: F.split(x, ":")[0]), row(short), F.lit("</table>"))
    found = F.transform(P.yearly_sales(html), lambda x: F.concat_ws(":", x["year"].cast("string"), x["sales"].cast("string")))
    return frame(spark, sf, "sheets").select("s_id", F.array_join(found, ";").alias("sales"))


query("h24_sheet_tables", f"SELECT s_id, list_avg(list_transform(list_filter(string_split(notes, ';'), lambda x: x <> ''), lambda x: CASE WHEN CAST(x AS DOUBLE) > 10 THEN CAST(x AS DOUBLE) / 2 ELSE CAST(x AS DOUBLE) END)) AS mean FROM {SH}")(
    lambda spark, sf: frame(spark, sf, "sheets").withColumn("html", F.concat(F.lit("<table>"), F.array_join(F.transform(F.filter(F.split("notes", ";"), lambda x: x != ""), lambda x: F.concat(F.lit("<tr><td>1.2 TCe</td><td>"), x, F.lit("</td></tr>"))), ""), F.lit("</table>"))).withColumn("n", P.engine_notes(F.col("html"))).select("s_id", F.try_divide(F.aggregate("n", F.lit(0.0), lambda a, x: a + x["note"]), F.size("n")).alias("mean"))
)
FAULT = "CASE " + " ".join(f"WHEN {has('lower(item)', ws)} THEN '{c}'" for c, ws in R.FAULT_CLASSES) + " ELSE 'autre' END"
query("h25_fault_classes", f"SELECT n, {FAULT} AS categorie FROM {IT}")(lambda spark, sf: frame(spark, sf, "items").withColumn("html", F.concat(F.lit('<div class="pannes"><ul><li>'), "item", F.lit("</li></ul></div>"))).select("n", F.explode(P.items(F.col("html"))).alias("item")).select("n", T.fault_class(F.col("item")).alias("categorie")))
query("h26_listing_cards", f"SELECT external_id, k, CAST(CAST(round(price) AS BIGINT) AS INT) AS price, CAST(km AS INT) AS km, year, fuel, gearbox FROM {LI}")(
    lambda spark, sf: frame(spark, sf, "listings").withColumn("card", F.concat_ws(" • ", F.concat(F.col("year").cast("string")), F.concat(F.format_string("%,d", F.col("km").cast("long")), F.lit(" km")), "fuel", "gearbox", F.concat(F.format_string("%,d", F.round("price").cast("long")), F.lit(" €")))).select("external_id", "k", P.card(F.col("card")).alias("c")).select("external_id", "k", "c.*")
)
ARTICLE = """
concat('<article class="card" data-guid="', external_id, '" data-make="', lower(trim(marque)), '" data-model="', lower(modele), '" data-price="', CAST(CAST(round(price) AS BIGINT) AS STRING), '" data-mileage="',
  CASE WHEN k % 7 = 0 THEN 'inconnu' ELSE CAST(CAST(km AS INT) AS STRING) END, '" data-first-registration="03-', CAST(year AS STRING), '" data-fuel-type="', CASE k % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'd' WHEN 2 THEN 'x' ELSE '2' END,
  '" data-listing-zip-code="', CASE WHEN k % 3 = 0 THEN '' ELSE '75011' END, '">', CASE WHEN k % 2 = 0 THEN '<h2><span>Belle offre</span><span>GT Line</span></h2>' ELSE '' END,
  CASE WHEN k % 5 = 0 THEN concat('<a href="/offres/', external_id, '">x</a>') ELSE '<a href="/autre">x</a>' END,
  '<img src="https://img.example.com/1.jpg 1x">', CASE WHEN k % 2 = 0 THEN '<source srcset="https://img.example.com/2.webp 2x">' ELSE '' END, '</article>')
"""
WORDED = "array_to_string(list_transform(string_split(lower(trim({0})), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("h26_card_attributes", f"""
SELECT external_id, k, 'https://www.autoscout24.fr/offres/' || CASE WHEN k % 5 = 0 THEN '' ELSE '-' END || external_id AS url, CASE WHEN k % 2 = 0 THEN 'Belle offre GT Line' ELSE {WORDED.format('marque')} || ' ' || {WORDED.format('modele')} END AS title,
  CAST(CAST(round(price) AS BIGINT) AS INT) AS price, CASE WHEN k % 7 <> 0 THEN CAST(km AS INT) END AS mileage, year, CASE k % 4 WHEN 0 THEN 'Essence' WHEN 1 THEN 'Diesel' WHEN 3 THEN 'Hybride' END AS fuel,
  CASE WHEN k % 3 <> 0 THEN '75011' END AS zipcode, 'https://img.example.com/' || CASE WHEN k % 2 = 0 THEN '2.webp' ELSE '1.jpg' END AS photo_url, {WORDED.format('marque')} AS brand, {WORDED.format('modele')} AS model FROM {LI}""")
def h26_attributes(spark, sf):
    return frame(spark, sf, "listings").select("k", P.attribute_card(F.expr(ARTICLE)).alias("c")).select("k", "c.*")


CARD_BRANDS = [b.strip().upper() for b in BRANDS]
LINK = """
concat('<a class="card" href="/auto-occasion-annonce-', CASE WHEN k % 4 = 0 THEN concat('x', external_id) ELSE concat(CAST(k AS STRING), '.html') END, '"><img data-src="https://img.example.com/', external_id, '.jpg">',
  CASE WHEN k % 3 = 0 THEN '<b>Bonne affaire</b>' ELSE '' END, CASE WHEN k % 11 = 0 THEN '' ELSE concat('<h3>', upper(trim(marque)), ' ', modele, '</h3>') END, '<i>', engine, '</i><p>', CAST(year AS STRING), '</p><p>', CASE gearbox WHEN 'automatique' THEN 'Auto.' ELSE 'Manuelle' END,
  '</p><p>', format_number(km, 0), ' KM</p><p>', CASE fuel WHEN 'hybride' THEN 'Hybrides' ELSE fuel END, '</p><p>', format_number(round(price), 0), ' €</p></a>')
"""


@query("h26_link_cards", f"""
SELECT CASE WHEN k % 4 = 0 THEN md5('/auto-occasion-annonce-x' || external_id)[1:12] ELSE CAST(k AS VARCHAR) END AS external_id, k, 'https://www.lacentrale.fr/auto-occasion-annonce-' || CASE WHEN k % 4 = 0 THEN 'x' || external_id ELSE k || '.html' END AS url,
  CASE WHEN k % 11 = 0 THEN 'Annonce La Centrale' ELSE upper(trim(marque)) || ' ' || modele END AS title, CAST(CAST(round(price) AS BIGINT) AS INT) AS price, CAST(km AS INT) AS mileage, year, upper(fuel[1]) || fuel[2:] AS fuel,
  upper(gearbox[1]) || gearbox[2:] AS transmission, 'https://img.example.com/' || external_id || '.jpg' AS photo_url, CASE WHEN k % 3 = 0 THEN '🏷️ Bonne affaire' END AS description FROM {LI}""")
def h26_links(spark, sf):
    return frame(spark, sf, "listings").select("k", P.link_card(F.expr(LINK), CARD_BRANDS).alias("c")).select("k", "c.*")


TAGGED = """
concat('<div class="ad"><a title="lien" href="/ad/voitures/', CASE WHEN k % 5 = 0 THEN 'x' ELSE concat(CAST(k AS STRING), '.htm') END, '">voir</a>', CASE WHEN k % 2 = 0 THEN concat('<p data-qa-id="aditem_title">', trim(marque), ' ', modele, '</p>') ELSE concat('<h2>', trim(marque), ' ', modele, '</h2>') END,
  '<span data-qa-id="aditem_price">', format_number(round(price), 0), ' €</span><span class="aditem_location">Paris 75011</span><img src="https://img.example.com/', external_id, '.jpg"><div class="aditem_tags">',
  CASE WHEN k % 3 = 0 THEN '' ELSE concat('<span>', CAST(year AS STRING), '</span><span>', CAST(CAST(km AS INT) AS STRING), ' km</span>') END, '<span>', initcap(fuel), '</span><span>', gearbox, '</span></div>',
  CASE WHEN k % 3 = 0 THEN concat('<p>Mise en circulation ', CAST(year AS STRING), '. Compteur : ', CAST(CAST(km AS INT) AS STRING), ' km</p>') ELSE '' END, '</div>')
"""


@query("h26_tag_cards", f"""
SELECT CASE WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) ELSE 'lbc' END AS external_id, k, 'https://www.leboncoin.fr/ad/voitures/' || CASE WHEN k % 5 = 0 THEN 'x' ELSE k || '.htm' END AS url, trim(marque) || ' ' || modele AS title, CAST(CAST(round(price) AS BIGINT) AS INT) AS price,
  'Paris 75011' AS city, year, CAST(km AS INT) AS mileage, CASE WHEN fuel <> 'electrique' THEN upper(fuel[1]) || fuel[2:] END AS fuel, upper(gearbox[1]) || gearbox[2:] AS transmission, 'https://img.example.com/' || external_id || '.jpg' AS photo_url FROM {LI} WHERE length(trim(marque) || ' ' || modele) >= 5""")
def h26_tags(spark, sf):
    cards = frame(spark, sf, "listings").select("k", F.explode(F.array(P.tag_card(F.expr(TAGGED)))).alias("c"))  # a row each, so the filter does not read the card again
    found = cards.where("c is not null").select("k", "c.*")
    return found.withColumn("external_id", F.regexp_replace("external_id", r"^lbc_[0-9]{1,8}$", "lbc"))


query("h26_identifier", f"SELECT external_id, k, md5(source || external_id)[1:12] AS ident FROM {LI}")(
    lambda spark, sf: frame(spark, sf, "listings").select("external_id", "k", P.identifier(F.lit(""), F.concat("source", "external_id")).alias("ident"))
)
LEGACY = """
concat('<div class="vehicle-container"><span class="vehicle-model">', replace(trim(marque), ' ', '-'), ' ', replace(modele, ' ', '-'), '</span><p class="vehicle-motorisation"> ', engine, ' </p><img class="lazyload" data-original="//img.example.com/',
  external_id, '.jpg"><b class="vehicle-loa-offer">', format_number(round(price), 0), ' €</b><i class="vehicle-transmission">', fuel, CASE WHEN k % 5 = 0 THEN '' ELSE concat(' - ', engine) END, '</i><em class="vehicle-zero-km">',
  CAST(year AS STRING), ' -- ', CAST(CAST(km AS INT) AS STRING), ' km</em><u class="equipment-tooltip-content"> Régulateur </u><u class="equipment-tooltip-content">GPS</u><a class="real-link vehicle-info-link" href="/achat/', external_id, '">x</a></div>')
"""
DETAIL = """concat('<p class="labels-body">Garantie</p>', CASE WHEN k % 3 = 0 THEN '' ELSE concat('<p class="labels-body"> Crit''Air ', CAST(k % 6 AS STRING), '</p>') END)"""
UNACCENTED = "translate(replace({}, ' ', '-'), 'éèêëÉË', 'eeeeEE')"


@query("h27_legacy_cards", f"""
SELECT external_id, k, {UNACCENTED.format('trim(marque)')} AS "Marque", {UNACCENTED.format('modele')} AS "Modele", engine AS "Sous-titre", 'https://img.example.com/' || external_id || '.jpg' AS "Image", replace(format('{{:,}}', CAST(round(price) AS BIGINT)), ' ', '') AS "Prix",
  CASE WHEN k % 5 = 0 THEN '' ELSE engine END AS "Motorisation", CASE WHEN k % 5 = 0 THEN '' ELSE fuel END AS "Carburant", CAST(year AS VARCHAR) AS "Annee", CAST(CAST(km AS INT) AS VARCHAR) AS "Kms", 'Regulateur,GPS' AS "Options",
  'https://www.aramisauto.com/achat/' || external_id AS "Lien", CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k % 6 AS VARCHAR) END AS "Crit'air" FROM {LI}""")
def h27(spark, sf):
    cards = frame(spark, sf, "listings").select("external_id", "k", P.legacy_card(F.expr(LEGACY), F.expr(DETAIL)).alias("c")).select("external_id", "k", "c.*")
    return cards.withColumn("Options", F.array_join("Options", ","))


KB = "CASE " + " ".join(f"WHEN contains(upper(product), '{b}') THEN '{b}'" for b in R.RECALL_BRANDS) + " ELSE upper(words[1]) END"
query("h28_recall_fields", f"SELECT ref, coalesce(upper(nullif(brand_field, '')), {KB}) AS brand, upper(words[2]) AS model, len(list_filter(list_transform(regexp_split_to_array(coalesce(shops, ''), '[,;\\n]'), lambda x: trim(x)), lambda x: x <> ''))::INT AS shops FROM (SELECT *, string_split(regexp_replace(trim(product), '\\s+', ' ', 'g'), ' ') AS words FROM {RC})")(
    lambda spark, sf: frame(spark, sf, "recalls").select("ref", P.recall_brand(F.col("brand_field"), F.col("product"), R.RECALL_BRANDS).alias("brand"), P.recall_model(F.col("product")).alias("model"), F.size(P.shops(F.col("shops"))).alias("shops"))
)
query("h29_recall_severity", f"SELECT ref, CASE WHEN {has('t', R.RECALL_CRITICAL)} THEN 'critical' WHEN {has('t', R.RECALL_SERIOUS)} THEN 'serious' ELSE 'moderate' END AS severity FROM (SELECT ref, lower(coalesce(risks, '') || ' ' || coalesce(motive, '')) AS t FROM {RC})")(lambda spark, sf: frame(spark, sf, "recalls").select("ref", T.recall_severity(F.col("risks"), F.col("motive")).alias("severity")))


# Cleaning: different items are cleaned once. Their SQL reads the same fixed rules; these items have no accents at words' ends.
def chained(x: str, rules: list[tuple[str, str]]) -> str:
    for p, r in rules:
        x = "regexp_replace({}, '(?i){}', '{}', 'g')".format(x, p.replace("'", "''"), r.replace("$3", r"\3").replace("'", "''"))
    return x


DIST = f"(SELECT DISTINCT item FROM {IT})"
distinct = lambda spark, sf: frame(spark, sf, "items").select("item").distinct()
filler, abbrev = [(p, "") for p in C.FILLERS], [(rf"\b{k}\b", v) for k, v in C.ABBREVIATIONS.items()]
for name, f, x in (
    ("h30_drop_fillers", C.drop_fillers, f"trim({chained('item', filler)})"), ("h31_expand", C.expand, chained("item", abbrev)), ("h32_neutralise", C.neutralise, f"trim({chained('item', C.EMOTIONAL)})"),
    ("h33_praise", C.praise, chained("item", C.PROS)), ("h33_complaint", C.complaint, chained("item", C.CONS)),
):
    query(name, f"SELECT item, {x} AS text FROM {DIST}")(lambda spark, sf, f=f: distinct(spark, sf).select("item", f(F.col("item")).alias("text")))
PUNCT = lambda t: rf"""(SELECT *, trim(CASE WHEN s2 <> '' AND NOT regexp_matches(s2, '[.!?]$') THEN s2 || '.' ELSE s2 END) AS p FROM (SELECT *, upper(s1[1]) || s1[2:] AS s2 FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '\s+([.,!?;:])', '\1', 'g'), '([.,!?;:])([A-Za-zÀ-ÿ])', '\1 \2', 'g') AS s1 FROM {t})))"""
query("h34_punctuate", f"SELECT item, p AS text FROM {PUNCT(f'(SELECT item, item AS x FROM {DIST})')}")(lambda spark, sf: distinct(spark, sf).select("item", C.punctuate(F.col("item")).alias("text")))
STEP3 = f"(SELECT item, trim({chained('e', C.EMOTIONAL)}) AS n FROM (SELECT item, {chained('f', abbrev)} AS e FROM (SELECT item, trim({chained('trim(item)', filler)}) AS f FROM {DIST})))"
CLEAN = {k: PUNCT(f"(SELECT item, {chained('n', v)} AS x FROM {STEP3})") for k, v in (("pro", C.PROS), ("con", C.CONS))}
for k, pro in (("pro", True), ("con", False)):
    query(f"h35_clean_{k}", f"SELECT item, CASE WHEN length(p) < 10 THEN '' ELSE p END AS text FROM {CLEAN[k]}")(lambda spark, sf, pro=pro: distinct(spark, sf).select("item", C.clean(F.col("item"), pro).alias("text")))
STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"
KW = f"list_sort(list_filter(list_distinct(regexp_extract_all(lower(item), '[{C.LETTERS}]{{3,}}')), lambda w: NOT list_contains({STOP}, w)))"
query("h36_keywords", f"SELECT item, array_to_string({KW}, ',') AS words FROM {DIST}")(lambda spark, sf: distinct(spark, sf).select("item", F.array_join(F.sort_array(C.keywords(F.col("item"))), ",").alias("words")))


#: One item a step; `kept` holds those taken so far.
ALIKE = f"len(list_intersect(kw, {KEYWORDS.format('k')})) > 0.6 * least(len(kw), len({KEYWORDS.format('k')}))"
H37 = f"""WITH RECURSIVE s AS (SELECT DISTINCT pros, cons, string_split(pros || ';' || cons || ';' || pros, ';') AS l FROM {SH}),
r AS (SELECT pros, cons, l, 0 AS i, CAST([] AS VARCHAR[]) AS kept FROM s
 UNION ALL SELECT pros, cons, l, i + 1, CASE WHEN len(kw) = 0 OR len(list_filter(kept, lambda k: {ALIKE})) > 0 THEN kept ELSE list_append(kept, l[i + 1]) END
 FROM (SELECT *, {KEYWORDS.format('l[i + 1]')} AS kw FROM r WHERE i < len(l)))
SELECT s_id, array_to_string(kept, ';') AS points FROM {SH} JOIN r USING (pros, cons) WHERE i = len(l)"""


@query("h37_distinct_items", H37)
def h37(spark, sf):
    """Greedy, in order, over the points of each sheet."""
    return frame(spark, sf, "sheets").select("s_id", F.array_join(C.distinct_items(F.split(F.concat_ws(";", "pros", "cons", "pros"), ";")), ";").alias("points"))


query("h38_changed_items", f"SELECT n, t AS text, CASE WHEN t <> trim(item) THEN item END AS original FROM (SELECT i.n, i.item, CASE WHEN length(p) < 10 THEN '' ELSE p END AS t FROM {IT} i JOIN {CLEAN['pro']} c ON c.item = i.item) WHERE t <> ''")(
    lambda spark, sf: frame(spark, sf, "items").join(distinct(spark, sf).select("item", F.explode(F.array(C.clean(F.col("item")))).alias("text")), "item").where("text <> ''").select("n", "text", F.when(F.col("text") != F.trim("item"), F.col("item")).alias("original"))
)
