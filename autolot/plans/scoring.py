"""Queries of scores, badges, costs and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from autolot.functions import refdata as R
from autolot.functions import scores as S
from autolot.functions import text as T
from autolot.plans.lifts import frame, sql
from autolot.plans.matching import BUDGET, CONSOLIDATED, FIVE, SEGSQL, WEIGHTS, consolidated, segmented
from autolot.plans.registry import query
from autolot.plans.sqltext import dbl, values

V, SH, LI, RE, MR = (sql(x) for x in ("vehicles", "sheets", "listings", "reviews", "model_reviews"))
c = F.col


def simple(name: str, table: str, ident: str, spark_columns: dict, sql_columns: str) -> None:
    ids = ident.split(", ")
    query(name, dbl(f"SELECT {ident}, {sql_columns} FROM {sql(table)}"))(lambda spark, sf: frame(spark, sf, table).select(*ids, *[e().alias(n) for n, e in spark_columns.items()]))


simple("h39_budget", "vehicles", "vehicle_id", {"budget": lambda: S.budget(c("conso"), c("co2"), c("carburant"))}, f"{BUDGET} AS budget")
query("h40_reliability", dbl(f"SELECT s_id, coalesce(round(list_avg(list_filter([nullif(score, 0), CASE WHEN faults > 5 THEN 5.0 WHEN faults > 3 THEN 6.0 WHEN faults > 0 THEN 7.0 ELSE 8.5 END, CASE WHEN engine_faults > 0 THEN engine_faults * 2.0 END], lambda x: x IS NOT NULL)), 1), 6.0) AS fiabilite FROM {SH}"))(
    lambda spark, sf: frame(spark, sf, "sheets").select("s_id", S.reliability(F.lit(True), c("score"), c("faults"), c("engine_faults").cast("double")).alias("fiabilite"))
)
simple("h41_from_reviews", "model_reviews", "r_id", {"confort": lambda: S.from_five(c("confort"), 6.0), "securite": lambda: S.from_five(c("securite"), 7.0), "habitabilite": lambda: S.from_five(c("habitabilite"), 6.0)}, ", ".join(f"{FIVE(x, d)} AS {x}" for x, d in (("confort", "6.0"), ("securite", "7.0"), ("habitabilite", "6.0"))))
query("h42_final_note", f"SELECT vehicle_id, note FROM {CONSOLIDATED}")(lambda spark, sf: consolidated(spark, sf).select("vehicle_id", "note"))
LABEL = "CASE WHEN nb_avis >= 5 THEN {} WHEN r_id % 2 = 0 THEN {} ELSE {} END"
query("h43_trust_badge", f"SELECT r_id, {LABEL.format(*[repr(x) for x in ('certified', 'verified', 'estimated')])} AS level, {LABEL.format(*[repr(x) for x in ('Certifié', 'Vérifié', 'Estimé')])} AS label, {LABEL.format(*[repr(x) for x in ('gold', 'silver', 'bronze')])} AS color FROM {MR}")(
    lambda spark, sf: frame(spark, sf, "model_reviews").select("r_id", S.badge(S.badge_level(c("r_id") % 2 == 0, F.lit(True), c("nb_avis"))).alias("b")).select("r_id", "b.level", "b.label", "b.color")
)
VERDICT = """'Le ' || marque || ' est un ' || CASE WHEN note >= 16 THEN 'excellent choix' WHEN note >= 14 THEN 'très bon choix' WHEN note >= 12 THEN 'bon choix' WHEN note >= 10 THEN 'choix correct' ELSE 'choix à considérer avec prudence' END
 || CASE WHEN len(s) > 0 THEN ', notamment grâce à sa ' || array_to_string(s[1:2], ', ') ELSE '' END || '. ' || CASE WHEN w <> '' THEN 'Attention toutefois à sa ' || w || '. ' ELSE '' END
 || CASE WHEN note >= 16 THEN 'Nous le recommandons vivement.' WHEN note >= 14 THEN 'Un achat que vous ne regretterez pas.' WHEN note >= 12 THEN 'Une option solide pour votre budget.' WHEN note >= 10 THEN 'Vérifiez bien l''historique d''entretien.' ELSE 'Nous conseillons une inspection approfondie.' END"""
query("h44_verdict", dbl(f"""SELECT vehicle_id, {VERDICT} AS verdict FROM (SELECT *, list_filter([CASE WHEN fiab >= 7.5 THEN 'fiabilité reconnue' END, CASE WHEN budg >= 7.5 THEN 'économique à l''usage' END, CASE WHEN conf >= 7.5 THEN 'confort apprécié' END], lambda x: x IS NOT NULL) AS s,
 concat_ws(', ', CASE WHEN fiab < 6 THEN 'fiabilité perfectible' END, CASE WHEN budg < 5 THEN 'coûts d''utilisation élevés' END) AS w FROM {CONSOLIDATED})"""))(lambda spark, sf: consolidated(spark, sf).select("vehicle_id", S.verdict(c("marque"), c("note"), c("fiab"), c("budg"), c("conf")).alias("verdict")))
query("h45_weighted_means", dbl(f"SELECT review_id, round(s / nullif(w, 0) * 2, 2) AS sur_20, round(s / nullif(w, 0), 2) AS sur_10 FROM (SELECT review_id, coalesce(fiabilite * 0.3, 0.0) + coalesce(confort * 0.2, 0.0) + coalesce(note * 0.2, 0.0) AS s, CASE WHEN fiabilite IS NULL THEN 0.0 ELSE 0.3 END + CASE WHEN confort IS NULL THEN 0.0 ELSE 0.2 END + CASE WHEN note IS NULL THEN 0.0 ELSE 0.2 END AS w FROM {RE})"))(
    lambda spark, sf: frame(spark, sf, "reviews").withColumn("m", S.weighted_mean([(c("fiabilite"), 0.30), (c("confort"), 0.20), (c("note"), 0.20)])).select("review_id", F.round(c("m") * 2, 2).alias("sur_20"), F.round("m", 2).alias("sur_10"))
)
simple("h46_reliability_badge", "reviews", "review_id", {"badge": lambda: S.quality_label(c("fiabilite"))}, "CASE WHEN fiabilite IS NULL THEN 'Non évalué' WHEN fiabilite >= 8.5 THEN 'Excellent' WHEN fiabilite >= 7 THEN 'Bon' WHEN fiabilite >= 5 THEN 'Moyen' WHEN fiabilite >= 3 THEN 'À éviter' ELSE 'Critique' END AS badge")
POINTS = "CASE WHEN note IS NULL THEN 0 ELSE 2 END + CASE WHEN fiabilite IS NULL THEN 0 ELSE 2 END + CASE WHEN length(content) > 50 THEN 2 ELSE 0 END + (km > 0)::INT + (date <> '')::INT + (n_pros > 0)::INT + (n_cons > 0)::INT"
simple("h47_review_confidence", "reviews", "review_id", {"points": lambda: pts(), "level": lambda: S.confidence_level(pts())}, f"{POINTS} AS points, CASE WHEN {POINTS} >= 7 THEN 'high' WHEN {POINTS} >= 4 THEN 'medium' ELSE 'low' END AS level")


def pts():
    return S.confidence_points(c("note"), c("fiabilite"), c("content"), c("km"), c("date"), c("n_pros"), c("n_cons"))


NP, NC = "len(list_filter(string_split(pros, ';'), lambda x: x <> ''))", "len(list_filter(string_split(cons, ';'), lambda x: x <> ''))"
n_of = lambda x: F.size(F.filter(F.split(x, ";"), lambda y: y != ""))
SHEET = f"greatest(0.0, least(10.0, 8.0 - CASE WHEN faults > 10 THEN 2.0 WHEN faults > 5 THEN 1.0 WHEN faults > 2 THEN 0.5 ELSE 0.0 END - engine_faults * 0.3 - gearbox_faults * 0.2 + CASE WHEN {NC} < 3 THEN 0.5 ELSE 0.0 END))"
sheet = lambda: S.sheet_reliability(c("faults"), c("engine_faults"), c("gearbox_faults"), n_of("cons"))
simple("h48_sheet_reliability", "sheets", "s_id", {"score": lambda: F.round(sheet(), 6)}, f"round({SHEET}, 6) AS score")
simple("h49_sheet_global", "sheets", "s_id", {"score": lambda: S.sheet_global(F.round(sheet(), 6), c("score"), n_of("pros"), n_of("cons"))}, f"coalesce(round(round(list_avg(list_filter([round({SHEET}, 6), score, CASE WHEN {NP} + {NC} > 0 THEN {NP} / greatest(1, {NP} + {NC}) * 10 END], lambda x: x IS NOT NULL)), 9), 1), 7.0) AS score")


def contextual(spark, sf):
    """Vehicles with all inputs of contextual scores, and the six scores."""
    df = segmented(frame(spark, sf, "vehicles"))
    k = c("vehicle_id")
    df = df.withColumns({
        "known": F.when(k % 4 == 0, 0.0).otherwise((k % 100) / 10), "faults": (k % 9).cast("int"), "reviews": (k % 90).cast("int"), "km": (k % 200 * 1000).cast("int"), "new_price": F.when(k % 6 == 0, 0.0).otherwise(c("prix") * (1 + k % 3)), "quote": F.when(k % 5 == 0, 0.0).otherwise(c("prix") * (0.8 + (k % 5) / 10)),
        "qualites": F.element_at(F.array(*[F.split(F.lit(x), ";") for x in PROS]), (k % len(PROS) + 1).cast("int")), "defauts": F.element_at(F.array(*[F.split(F.lit(x), ";") for x in CONS]), (k % len(CONS) + 1).cast("int")),
    })
    return df.withColumns({
        "s_fiab": S.contextual_reliability(c("known"), c("faults"), c("reviews"), c("km")), "s_cout": S.contextual_cost(F.coalesce("conso", F.lit(0.0)), c("carburant"), c("modele"), c("prix"), c("new_price"), c("segment")), "s_conf": S.contextual_comfort(c("qualites"), c("defauts"), c("segment")),
        "s_perf": S.contextual_performance(c("puissance"), c("qualites"), c("segment")), "s_val": S.contextual_value(c("prix"), c("quote"), c("new_price"), c("annee_debut")), "s_secu": S.contextual_safety(c("annee_debut"), c("qualites")),
    })


PROS = ["Confort;habitabilite;silence;suspension", "tenue de route;direction;freins", "airbags;assistance", "coffre"]
CONS = ["suspensions fermes;peu de confort;espace;insonorisation", "prix", "bruit"]
K = "vehicle_id"
pick = lambda xs: f"CASE {K} % {len(xs)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
CNT = lambda col, ws: f"len(list_filter(string_split({col}, ';'), lambda x: " + " OR ".join(f"contains(lower(x), '{w}')" for w in ws) + "))"
CL = lambda x: f"greatest(0.0, least(10.0, {x}))"
REFS = values([(k, *v) for k, v in R.CONSUMPTION_REFERENCES.items()], "cr(fk, best, fair, bad)")
PREF = "CASE segment WHEN 'Budget' THEN {0} WHEN 'Premium' THEN {1} ELSE {2} END"
AGE = "CASE 2026 - annee_debut " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(R.VALUE_BY_AGE)) + " ELSE 0.30 END"
CTX = dbl(f"""(WITH a AS (SELECT *, CASE WHEN {K} % 4 = 0 THEN 0.0 ELSE ({K} % 100) / 10 END AS known, {K} % 9 AS faults, {K} % 90 AS reviews, {K} % 200 * 1000 AS km, CASE WHEN {K} % 6 = 0 THEN 0.0 ELSE prix * (1 + {K} % 3) END AS new_price, CASE WHEN {K} % 5 = 0 THEN 0.0 ELSE prix * (0.8 + ({K} % 5) / 10) END AS quote, {pick(PROS)} AS q, {pick(CONS)} AS d, coalesce(conso, 0.0) AS co,
 CASE WHEN contains(carburant, 'electr') OR contains(carburant, 'ev') OR contains(lower(modele), 'model 3') OR contains(lower(modele), 'e-') THEN 'electrique' WHEN contains(carburant, 'hybrid') THEN 'hybride' WHEN contains(carburant, 'diesel') THEN 'diesel' ELSE 'essence' END AS fk FROM {SEGSQL}),
b AS (SELECT a.*, best, fair, bad, CASE WHEN new_price > 0 THEN prix / new_price END AS r, CASE WHEN quote > 0 THEN prix / quote END AS rq FROM a JOIN {REFS} USING (fk)),
e AS (SELECT *, CASE WHEN known > 0 THEN known ELSE 5.0 END - least(faults * 0.3, 2.0) + CASE WHEN reviews > 50 AND known >= 7 THEN 0.5 ELSE 0.0 END AS f0,
 5.0 + CASE WHEN co <= 0 THEN 0.0 WHEN co <= best THEN 2.5 WHEN co <= fair THEN 1.0 WHEN co >= bad THEN -1.0 ELSE 0.0 END + CASE WHEN r < 0.4 THEN 1.5 WHEN r < 0.6 THEN 0.5 WHEN r > 0.85 THEN -1.0 ELSE 0.0 END AS c0,
 5.0 + least({CNT('q', R.COMFORT_WORDS)} * 0.5, 2.0) - least({CNT('d', R.COMFORT_WORDS)} * 0.5, 1.5) AS m0 FROM b)
SELECT *, {CL('f0 - CASE WHEN km > 150000 AND f0 < 7 THEN 0.5 ELSE 0.0 END')} AS s_fiab, {CL("c0 + CASE WHEN segment IN ('Budget', 'Volume') AND c0 >= 7 THEN 0.5 ELSE 0.0 END")} AS s_cout, {CL("m0 + CASE WHEN segment IN ('Premium', 'Luxury_Sport', 'Luxury') THEN CASE WHEN m0 >= 7 THEN 1.0 WHEN m0 < 5 THEN -0.5 ELSE 0.0 END ELSE 0.0 END")} AS s_conf,
 {CL(f"5.0 + CASE WHEN puissance >= {PREF.format(110, 250, 180)} THEN 2.0 WHEN puissance >= {PREF.format(90, 180, 130)} THEN 1.0 WHEN puissance < {PREF.format(90, 180, 130)} * 0.6 THEN -1.0 ELSE 0.0 END + least({CNT('q', R.DYNAMIC_WORDS)} * 0.4, 1.5)")} AS s_perf,
 {CL(f"5.0 + CASE WHEN rq < 0.9 THEN least((1 - rq) * 10, 2.0) WHEN rq > 1.1 THEN -least((rq - 1) * 5, 1.5) ELSE 0.0 END + CASE WHEN r > {AGE} * 1.1 THEN 1.5 WHEN r < {AGE} * 0.85 THEN -1.0 ELSE 0.0 END")} AS s_val,
 {CL(f"5.0 + CASE WHEN annee_debut >= 2022 THEN 2.0 WHEN annee_debut >= 2019 THEN 1.0 WHEN annee_debut < 2015 THEN -1.0 ELSE 0.0 END + least({CNT('q', R.SAFETY_WORDS)} * 0.5, 1.5)")} AS s_secu FROM e)""")
for name, col in (("h50_contextual_reliability", "s_fiab"), ("h51_contextual_cost", "s_cout"), ("h52_contextual_comfort", "s_conf"), ("h53_contextual_performance", "s_perf"), ("h54_contextual_value", "s_val"), ("h55_contextual_safety", "s_secu")):
    query(name, f"SELECT vehicle_id, round({col}, 6) AS score FROM {CTX}")(lambda spark, sf, col=col: contextual(spark, sf).select("vehicle_id", F.round(col, 6).alias("score")))
WT = values([(k, *[0.0 if x is None else x for x in v]) for k, v in WEIGHTS.items()], "wt(ws, wf, wc, wm, wu, wp, wv, wa)")
GLOBAL = "round(round(greatest(0, least(20, 2 * (s_fiab * wf + s_cout * wc + s_conf * wm + s_secu * wu + s_perf * wp + s_val * wv + (s_cout + s_perf) / 2 * wa))), 9), 1)"
CONFID = dbl("round(least(1.0, 0.3 + CASE WHEN known > 0 THEN 0.2 ELSE 0.0 END + 0.15 + CASE WHEN new_price > 0 THEN 0.15 ELSE 0.0 END + CASE WHEN co > 0 THEN 0.1 ELSE 0.0 END + CASE WHEN reviews > 20 THEN 0.1 ELSE 0.0 END), 2)")


@query("h56_contextual_global", f"SELECT vehicle_id, {GLOBAL} AS score, round(round((s_fiab + s_cout + s_conf + s_secu + s_perf + s_val) / 3, 9), 1) AS unweighted, {CONFID} AS confidence, concat_ws(';', CASE WHEN s_fiab >= 7 THEN 'Fiabilité reconnue' END, CASE WHEN s_cout >= 7 THEN 'Coût d''usage maîtrisé' END, CASE WHEN s_conf >= 7 THEN 'Bon confort' END, CASE WHEN s_perf >= 7 THEN 'Performances satisfaisantes' END) AS forces, CASE WHEN {GLOBAL} >= 16 THEN 'Excellent choix dans le segment ' || segment WHEN {GLOBAL} >= 13 THEN 'Bon véhicule pour le segment ' || segment WHEN {GLOBAL} >= 10 THEN 'Correct, mais des alternatives existent en ' || segment ELSE 'À considérer avec prudence' END AS verdict FROM {CTX} JOIN {WT} ON ws = weights_of")
def h56(spark, sf):
    df = contextual(spark, sf)
    w = lambda i: T.lookup({k: 0.0 if v[i] is None else v[i] for k, v in WEIGHTS.items()}, c("weights_of"))
    total = c("s_fiab") * w(0) + c("s_cout") * w(1) + c("s_conf") * w(2) + c("s_secu") * w(3) + c("s_perf") * w(4) + c("s_val") * w(5) + (c("s_cout") + c("s_perf")) / 2 * w(6)
    df = df.withColumn("score", S.tidy(S.clamp(total * 2, 0.0, 20.0), 1))
    conf = F.lit(0.3) + F.when(c("known") > 0, 0.2).otherwise(0.0) + F.when(F.size("qualites") > 0, 0.15).otherwise(0.0) + F.when(c("new_price") > 0, 0.15).otherwise(0.0) + F.when(c("conso") > 0, 0.1).otherwise(0.0) + F.when(c("reviews") > 20, 0.1).otherwise(0.0)
    strong = F.concat_ws(";", F.when(c("s_fiab") >= 7, "Fiabilité reconnue"), F.when(c("s_cout") >= 7, "Coût d'usage maîtrisé"), F.when(c("s_conf") >= 7, "Bon confort"), F.when(c("s_perf") >= 7, "Performances satisfaisantes"))
    said = F.when(c("score") >= 16, F.concat(F.lit("Excellent choix dans le segment "), "segment")).when(c("score") >= 13, F.concat(F.lit("Bon véhicule pour le segment "), "segment")).when(c("score") >= 10, F.concat(F.lit("Correct, mais des alternatives existent en "), "segment")).otherwise("À considérer avec prudence")
    plain = S.tidy((c("s_fiab") + c("s_cout") + c("s_conf") + c("s_secu") + c("s_perf") + c("s_val")) / 3, 1)
    return df.select("vehicle_id", "score", plain.alias("unweighted"), F.round(F.least(F.lit(1.0), conf), 2).alias("confidence"), strong.alias("forces"), said.alias("verdict"))


simple("h57_body_category", "vehicles", "vehicle_id", {"category": lambda: S.body_category(c("modele"))}, "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(modele), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in R.CATEGORIES) + " ELSE 'Unknown' END AS category")
PRICE = "CASE carburant " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.FUEL_PRICES.items()) + " ELSE 1.75 END"
USE = "CASE WHEN conso > 0 THEN conso ELSE CASE carburant " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.DEFAULT_CONSUMPTION.items()) + " ELSE 6.5 END END"
query("h58_ownership_cost", dbl(f"SELECT vehicle_id, round(u, 1) AS consumption, CASE WHEN conso > 0 THEN 'ademe' ELSE 'estimation' END AS source, round(f, 2) AS fuel, round(1000 * 0.093, 2) AS upkeep, round(f + 1000 * 0.093, 2) AS month, round((f + 1000 * 0.093) * 12, 2) AS year FROM (SELECT *, 1000 / 100 * u * ({PRICE}) AS f FROM (SELECT *, {USE} AS u FROM {V}))"))(lambda spark, sf: frame(spark, sf, "vehicles").select("vehicle_id", S.ownership(c("conso"), c("carburant")).alias("o")).select("vehicle_id", "o.*"))


@query("h59_monthly_fuel", dbl(f"SELECT vehicle_id, round((coalesce(conso, 7.0) / 100 * 1500)::DECIMAL(18, 9), 1)::DOUBLE AS litres, round((coalesce(conso, 7.0) / 100 * 1500 * 1.695)::DECIMAL(18, 9), 2)::DOUBLE AS cost FROM {V}"))
def h59(spark, sf):
    litres = F.coalesce("conso", F.lit(7.0)) / 100 * 1500
    return frame(spark, sf, "vehicles").select("vehicle_id", S.tidy(litres, 1).alias("litres"), S.tidy(litres * 1.695, 2).alias("cost"))


PROFILE = "CASE vehicle_id % 4 WHEN 0 THEN 'citadine' WHEN 1 THEN 'berline' WHEN 2 THEN 'suv' ELSE 'autre' END"
YEARLY = "(km * CASE p WHEN 'citadine' THEN 0.084 WHEN 'berline' THEN 0.092 WHEN 'suv' THEN 0.105 ELSE 0.093 END)"
H60 = f"""SELECT vehicle_id, round(CASE p WHEN 'berline' THEN 480 + 40 * cv WHEN 'suv' THEN 550 + 45 * cv ELSE 380 + 35 * cv END / 12, 2) AS insurance,
 round(CASE WHEN km < 10000 THEN greatest(800.0, {YEARLY}) WHEN km > 25000 THEN {YEARLY} * 1.05 ELSE {YEARLY} END, 2) AS upkeep
FROM (SELECT vehicle_id, vehicle_id % 40 * 1000 AS km, 4 + vehicle_id % 9 AS cv, {PROFILE} AS p FROM {V})"""


@query("h60_insurance_and_upkeep", dbl(H60))
def h60(spark, sf):
    profile, km, fiscal = F.expr(PROFILE), c("vehicle_id") % 40 * 1000, 4 + c("vehicle_id") % 9
    return frame(spark, sf, "vehicles").select("vehicle_id", S.insurance(profile, fiscal).alias("insurance"), S.upkeep(profile, km).alias("upkeep"))


query("h61_engine_alerts", dbl(f"SELECT vehicle_id, CASE WHEN contains(lower(designation), 'puretech') THEN 'puretech' WHEN contains(lower(designation), 'tce') THEN 'tce' END AS engine, CASE WHEN contains(lower(designation), 'puretech') THEN -1.5 WHEN contains(lower(designation), 'tce') THEN -1.0 ELSE 0.0 END AS adjustment FROM {V}"))(
    lambda spark, sf: frame(spark, sf, "vehicles").withColumn("engine", S.alert_engine(c("designation"))).select("vehicle_id", "engine", S.alert_adjustment(c("engine")).alias("adjustment"))
)
query("h62_adjusted_scores", dbl(f"SELECT vehicle_id, f2 AS fiabilite, round((f2 * 0.3 + conf * 0.2 + budg * 0.2 + habi * 0.15 + secu * 0.15) * 2, 1) AS weighted, round((f2 * 0.4 + conf * 0.2 + budg * 0.2 + secu * 0.1 + habi * 0.1) * 2, 1) AS recomputed FROM (SELECT *, greatest(0, least(10, fiab + CASE WHEN contains(lower(designation), 'puretech') THEN -1.5 WHEN contains(lower(designation), 'tce') THEN -1.0 ELSE 0.0 END)) AS f2 FROM {CONSOLIDATED})"))(
    lambda spark, sf: consolidated(spark, sf).withColumn("f2", S.clamp(c("fiab") + S.alert_adjustment(S.alert_engine(c("designation"))))).select("vehicle_id", c("f2").alias("fiabilite"), F.round((c("f2") * 0.3 + c("conf") * 0.2 + c("budg") * 0.2 + c("habi") * 0.15 + c("secu") * 0.15) * 2, 1).alias("weighted"), S.final_note(c("f2"), c("conf"), c("budg"), c("secu"), c("habi")).alias("recomputed"))
)
DEAL = "round((coalesce(nullif(expert, 0), 10.0) / 20 * 40 + CASE WHEN km <= 0 THEN 0 WHEN km / greatest(1, 2026 - year) < 10000 THEN 20 WHEN km / greatest(1, 2026 - year) < 15000 THEN 15 WHEN km / greatest(1, 2026 - year) < 20000 THEN 10 ELSE 5 END + CASE WHEN price < 10000 THEN 20 WHEN price < 20000 THEN 25 WHEN price < 30000 THEN 30 ELSE 15 END + CASE alerts WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END - 50) * 2, 1)"
simple("h63_deal_score", "listings", "external_id, k", {"deal": lambda: deal(), "good": lambda: deal() > 20}, f"{DEAL} AS deal, {DEAL} > 20 AS good")


def deal():
    return S.deal_score(c("expert"), c("km"), c("year"), c("price"), c("alerts"))


query("h64_recommendation", f"SELECT vehicle_id, CASE WHEN note >= 15 AND fiab >= 7 THEN 'excellent' WHEN note >= 12 AND fiab >= 5 THEN 'bon' WHEN note >= 10 THEN 'acceptable' ELSE 'prudence' END AS advice FROM {CONSOLIDATED}")(lambda spark, sf: consolidated(spark, sf).select("vehicle_id", S.recommendation(c("note"), c("fiab")).alias("advice")))
simple("h65_crit_air_and_note", "vehicles", "vehicle_id", {"critair": lambda: S.crit_air(c("carburant"), c("annee_fin")), "note": lambda: S.legacy_note(c("carburant"), c("boite"), c("annee_debut"))},
       "CASE WHEN carburant = 'electrique' THEN 0 WHEN annee_fin IS NULL THEN 3 WHEN carburant IN ('essence', 'hybride', 'hybride_rechargeable') THEN CASE WHEN annee_fin >= 2011 THEN 1 WHEN annee_fin >= 2006 THEN 2 ELSE 3 END WHEN carburant = 'diesel' AND annee_fin >= 2011 THEN 2 ELSE 3 END AS critair, greatest(0, least(20, 12.0 + CASE carburant WHEN 'electrique' THEN 2.0 WHEN 'hybride' THEN 1.5 ELSE 0.0 END + CASE WHEN boite = 'automatique' THEN 0.5 ELSE 0.0 END + CASE WHEN annee_debut >= 2020 THEN 1.0 ELSE 0.0 END))::DOUBLE AS note")
query("h66_traced_values", f"SELECT review_id, coalesce(fiabilite, 7.0::DOUBLE) AS value, CASE WHEN fiabilite IS NULL THEN 'estimated' ELSE 'verified_scrape' END AS confidence, fiabilite IS NOT NULL AS verified FROM {RE}")(
    lambda spark, sf: frame(spark, sf, "reviews").select("review_id", F.struct(F.coalesce("fiabilite", F.lit(7.0)).alias("value"), F.struct(F.when(c("fiabilite").isNull(), "estimated").otherwise("verified_scrape").alias("confidence"), c("fiabilite").isNotNull().alias("verified")).alias("_source")).alias("v")).select("review_id", "v.value", "v._source.confidence", "v._source.verified")
)
OPTIONS = {"Confort de conduite": 3, "coffre": 2, "tenue de route et direction": 4, "Silence à bord": 1}


@query("h67_option_number", f"SELECT s_id, coalesce(try_cast(array_to_string(list_transform(string_split(pros, ';'), lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPTIONS.items()) + f" ELSE '' END), '') AS INT), 0) AS number, coalesce(list_sum(list_transform(string_split(pros, ';'), lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in OPTIONS.items()) + f" ELSE 0 END)), 0)::INT AS total FROM {SH}")
def h67(spark, sf):
    digit = F.transform(F.split("pros", ";"), lambda x: F.coalesce(T.lookup(OPTIONS, x), F.lit(0)))
    text = F.array_join(F.transform(F.filter(digit, lambda x: x > 0), lambda x: x.cast("string")), "")
    return frame(spark, sf, "sheets").select("s_id", F.coalesce(text.try_cast("int"), F.lit(0)).alias("number"), F.aggregate(digit, F.lit(0), lambda a, x: a + x).alias("total"))


query("h68_registration", f"SELECT vehicle_id, annee_debut AS year, 2026 - annee_debut AS age FROM {V}")(lambda spark, sf: frame(spark, sf, "vehicles").withColumn("m", F.concat(F.lit("07-"), c("annee_debut").cast("string"))).withColumn("year", F.split("m", "-")[1].try_cast("int")).select("vehicle_id", "year", (2026 - c("year")).alias("age")))
query("h69_row_from_features", f"SELECT vehicle_id, CASE WHEN vehicle_id % 3 = 0 THEN 100 ELSE puissance END AS puissance, CASE WHEN vehicle_id % 4 = 0 THEN 2020 ELSE annee_debut END AS annee, (CASE WHEN vehicle_id % 3 = 0 THEN 100 ELSE puissance END)::VARCHAR || 'ch' AS motorisation, 0 AS nb_reviews FROM {V}")(
    lambda spark, sf: frame(spark, sf, "vehicles").withColumns({"p": F.coalesce(F.when(c("vehicle_id") % 3 != 0, c("puissance")), F.lit(100)), "annee": F.coalesce(F.when(c("vehicle_id") % 4 != 0, c("annee_debut")), F.lit(2020))}).select("vehicle_id", c("p").alias("puissance"), "annee", F.concat(c("p").cast("string"), F.lit("ch")).alias("motorisation"), F.lit(0).alias("nb_reviews"))
)
query("h70_answer_confidence", f"SELECT vehicle_id, CASE badge WHEN 'certified' THEN 'high' WHEN 'verified' THEN 'medium' ELSE 'low' END AS confidence FROM {CONSOLIDATED}")(lambda spark, sf: consolidated(spark, sf).select("vehicle_id", F.when(c("badge") == "certified", "high").when(c("badge") == "verified", "medium").otherwise("low").alias("confidence")))
