"""Queries of joins between sources, of first matches, and of whole consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from autolot.functions import refdata as R
from autolot.functions import scores as Sc
from autolot.functions import text as T
from autolot.operators import matching as M
from autolot.operators import rows
from autolot.operators import similarity
from autolot.plans.lifts import frame, sql
from autolot.plans.registry import query
from autolot.sources.files import materialize
from autolot.plans.sqltext import brand, dbl, has, indel, norm, token_sets, values

V, SH, RV, LI, RE, RC = (sql(x) for x in ("vehicles", "sheets", "model_reviews", "listings", "reviews", "recalls"))


def keyed(df):
    """Vehicles with brand block, normalised designation and model, and both keys."""
    model = T.model_of_designation(F.col("designation"), F.col("marque"))
    df = df.withColumns({"block": T.normalize_brand(F.col("marque")), "text": T.normalize(F.col("designation")), "model": model})
    return df.withColumns({"key1": F.concat_ws("_", "block", "model"), "key2": F.concat_ws("_", F.col("block"), T.normalize(F.col("modele")))})


def indexed(df, ident):
    """The last row of each key, with block and normalised model."""
    df = df.withColumns({"block": T.normalize_brand(F.col("marque")), "other": T.normalize(F.col("modele"))})
    return rows.last_write(df.withColumn("key", F.concat_ws("_", "block", "other")), ["key"], [ident])


MODEL = r"lower(coalesce(nullif(regexp_extract(d, '^([A-Z]?\d{1,4}[A-Z]?)\b', 1), ''), nullif(regexp_extract(d, '^([A-Z][A-Z\-]+)\b', 1), ''), regexp_replace(string_split(d, ' ')[1], '^[()]+|[()]+$', '', 'g')))"
KEYED = f"(SELECT *, block || '_' || model AS key1, block || '_' || {norm('modele')} AS key2 FROM (SELECT *, {MODEL} AS model FROM (SELECT *, {brand('marque')} AS block, {norm('designation')} AS text, CASE WHEN starts_with(upper(trim(designation)), upper(marque)) THEN trim(upper(trim(designation))[length(marque) + 1:]) ELSE upper(trim(designation)) END AS d FROM {V})))"
indexed_sql = lambda t, i: f"(SELECT * FROM (SELECT *, block || '_' || other AS key FROM (SELECT *, {brand('marque')} AS block, {norm('modele')} AS other FROM {t})) QUALIFY row_number() OVER (PARTITION BY key ORDER BY {i} DESC) = 1)"


def matched_sql(t: str, i: str, second: bool) -> str:
    exact = f"coalesce(a.{i}, b.{i})" if second else f"a.{i}"
    inner = f"""(SELECT v.vehicle_id, v.block, v.text, v.model, {exact} AS hit FROM k v LEFT JOIN x a ON a.key = v.key1 LEFT JOIN x b ON b.key = v.key2)"""
    return f"""WITH k AS {KEYED}, x AS {indexed_sql(t, i)}, e AS {inner},
p AS (SELECT e.vehicle_id, min(x.{i}) AS hit FROM e JOIN x ON x.block = e.block AND ((x.other <> '' AND contains(e.text, x.other)) OR (e.model <> '' AND contains(x.other, e.model))) WHERE e.hit IS NULL GROUP BY 1)
SELECT e.vehicle_id, coalesce(e.hit, p.hit) AS {i}, CASE WHEN e.hit IS NOT NULL THEN 'exact' WHEN p.hit IS NOT NULL THEN 'partial' ELSE 'none' END AS step FROM e LEFT JOIN p USING (vehicle_id)"""


NAMES = ["marque", "modele", "designation"]


def matched(spark, sf, name, ident, keys):
    """Different names are normalised and matched once; vehicles then look their names up."""
    v = frame(spark, sf, "vehicles")
    left = materialize(keyed(rows.different(v, *NAMES)), "names")
    right = materialize(indexed(frame(spark, sf, name), ident), "index")
    found = M.match(left, right, "", keys, "key", "block", "text", "model", "other", ident).select(*NAMES, ident, "step")
    return v.select("vehicle_id", *NAMES).join(found, NAMES).select("vehicle_id", ident, "step")


query("c1_c2_match_sheets", matched_sql(SH, "s_id", True))(lambda spark, sf: matched(spark, sf, "sheets", "s_id", ["key1", "key2"]).select("vehicle_id", "s_id", "step"))
query("c3_match_reviews", matched_sql(RV, "r_id", False))(lambda spark, sf: matched(spark, sf, "model_reviews", "r_id", ["key1"]).select("vehicle_id", "r_id", "step"))
query("c1_exact_sheets", f"WITH k AS {KEYED}, x AS {indexed_sql(SH, 's_id')} SELECT k.vehicle_id, coalesce(a.s_id, b.s_id) AS s_id FROM k LEFT JOIN x a ON a.key = key1 LEFT JOIN x b ON b.key = key2")(lambda spark, sf: M.exact_match(keyed(frame(spark, sf, "vehicles")), indexed(frame(spark, sf, "sheets"), "s_id"), "vehicle_id", ["key1", "key2"], "key", "s_id").select("vehicle_id", "s_id"))
C2 = f"""WITH k AS {KEYED}, x AS {indexed_sql(SH, 's_id')}
SELECT k.block, text, model, min(s_id) AS s_id FROM (SELECT DISTINCT block, text, model FROM k) k
JOIN x ON x.block = k.block AND ((other <> '' AND contains(text, other)) OR (model <> '' AND contains(other, model))) GROUP BY ALL"""


@query("c2_partial_sheets", C2)
def c2(spark, sf):
    names = materialize(keyed(rows.different(frame(spark, sf, "vehicles"), *NAMES)).select("block", "text", "model").distinct(), "names")
    sheets = materialize(indexed(frame(spark, sf, "sheets"), "s_id").select("block", "other", "s_id"), "index")
    return M.partial_match(names, sheets, "block", "text", "model", "other", "s_id")


def consolidated(spark, sf):
    """Vehicles with scores, note and badge from their sheet and reviews."""
    sheets = frame(spark, sf, "sheets").select(F.col("s_id"), F.col("score"), F.col("faults"), F.split("pros", ";").alias("pros"))
    revs = frame(spark, sf, "model_reviews").select("r_id", "nb_avis", "fiabilite", F.col("confort").alias("r_confort"), "securite", "habitabilite")
    base = frame(spark, sf, "vehicles")
    s = matched(spark, sf, "sheets", "s_id", ["key1", "key2"]).select("vehicle_id", "s_id")
    r = matched(spark, sf, "model_reviews", "r_id", ["key1"]).select("vehicle_id", "r_id")
    df = base.join(s, "vehicle_id").join(r, "vehicle_id").join(sheets, "s_id", "left").join(revs, "r_id", "left")
    has_s, has_r = F.col("s_id").isNotNull(), F.col("r_id").isNotNull()
    df = df.withColumns({
        "fiab": Sc.reliability(has_s, F.col("score"), F.col("faults"), F.col("fiabilite")), "conf": Sc.from_five(F.col("r_confort"), 6.0), "budg": Sc.budget(F.col("conso"), F.col("co2"), F.col("carburant")), "secu": Sc.from_five(F.col("securite"), 7.0), "habi": Sc.from_five(F.col("habitabilite"), 6.0),
        "nb": F.coalesce("nb_avis", F.lit(0)), "qualites": F.array_join(F.slice(F.coalesce("pros", F.array().cast("array<string>")), 1, 10), ";"), "has_sheet": has_s, "has_review": has_r,
    })
    df = df.withColumn("note", Sc.final_note(F.col("fiab"), F.col("conf"), F.col("budg"), F.col("secu"), F.col("habi")))
    return df.withColumn("badge", Sc.badge_level(has_s, has_r, F.col("nb")))


BUDGET = "greatest(0, least(10, 5 + CASE WHEN coalesce(conso, 0) = 0 THEN 0 WHEN conso < 4 THEN 2.5 WHEN conso < 5 THEN 2 WHEN conso < 6 THEN 1 WHEN conso < 7 THEN 0 WHEN conso < 9 THEN -1 ELSE -2 END + CASE WHEN coalesce(co2, 0) = 0 THEN 0 WHEN co2 < 100 THEN 1.5 WHEN co2 < 130 THEN 0.5 WHEN co2 > 200 THEN -1 ELSE 0 END + CASE WHEN contains(carburant, 'electrique') THEN 1.5 WHEN contains(carburant, 'hybride') THEN 0.5 ELSE 0 END))::DOUBLE"
FIVE = lambda c, d: f"CASE WHEN coalesce({c}, 0) = 0 THEN {d} ELSE least(10.0, {c} * 2) END"
RELIABLE = "coalesce(round(list_avg(list_filter([CASE WHEN s_id IS NOT NULL AND score <> 0 THEN score END, CASE WHEN s_id IS NULL THEN NULL WHEN faults > 5 THEN 5.0 WHEN faults > 3 THEN 6.0 WHEN faults > 0 THEN 7.0 ELSE 8.5 END, CASE WHEN fiabilite <> 0 THEN fiabilite * 2 END], lambda x: x IS NOT NULL)), 1), 6.0)"
CONSOLIDATED = dbl(f"""(WITH ms AS ({matched_sql(SH, 's_id', True)}), mr AS ({matched_sql(RV, 'r_id', False)}),
j AS (SELECT v.*, ms.s_id, mr.r_id, score, faults, pros, nb_avis, fiabilite, confort AS r_confort, securite, habitabilite FROM {V} v JOIN ms USING (vehicle_id) JOIN mr USING (vehicle_id) LEFT JOIN {SH} s ON s.s_id = ms.s_id LEFT JOIN {RV} r ON r.r_id = mr.r_id),
c AS (SELECT *, {RELIABLE} AS fiab, {FIVE('r_confort', '6.0')} AS conf, {BUDGET} AS budg, {FIVE('securite', '7.0')} AS secu, {FIVE('habitabilite', '6.0')} AS habi, coalesce(nb_avis, 0) AS nb, coalesce(pros, '') AS qualites, s_id IS NOT NULL AS has_sheet, r_id IS NOT NULL AS has_review FROM j)
SELECT *, round((fiab * 0.4 + conf * 0.2 + budg * 0.2 + secu * 0.1 + habi * 0.1) * 2, 1) AS note, CASE WHEN has_review AND nb >= 5 THEN 'certified' WHEN has_sheet THEN 'verified' ELSE 'estimated' END AS badge FROM c)""")
CC = "vehicle_id, s_id, r_id, has_sheet, has_review, fiab, conf, budg, secu, habi, note, badge, nb, qualites"
query("c4_consolidate", f"SELECT {CC} FROM {CONSOLIDATED}")(lambda spark, sf: consolidated(spark, sf).select(*CC.split(", ")))
query("w1_best_vehicles", f"SELECT vehicle_id, marque, modele, note, badge FROM {CONSOLIDATED} ORDER BY note DESC, vehicle_id LIMIT 20")(lambda spark, sf: rows.page(consolidated(spark, sf).select("vehicle_id", "marque", "modele", "note", "badge"), [F.desc("note"), F.col("vehicle_id")], 0, 20))
query("d10_summary", f"SELECT count(*) AS total, sum(has_sheet::INT)::BIGINT AS sheets, sum(has_review::INT)::BIGINT AS reviews, sum((badge = 'certified')::INT)::BIGINT AS certified, CAST(floor(100 * sum(has_sheet::INT) / count(*)) AS BIGINT) AS sheet_pct, CAST(floor(100 * sum(has_review::INT) / count(*)) AS BIGINT) AS review_pct FROM {CONSOLIDATED}")(
    lambda spark, sf: consolidated(spark, sf).agg(F.count("*").alias("total"), F.count_if("has_sheet").alias("sheets"), F.count_if("has_review").alias("reviews"), F.count_if(F.col("badge") == "certified").alias("certified")).withColumns({"sheet_pct": F.floor(100 * F.col("sheets") / F.col("total")), "review_pct": F.floor(100 * F.col("reviews") / F.col("total"))})
)
query("c18_matched_sources", f"WITH m AS ({matched_sql(SH, 's_id', True)}) SELECT s_id FROM {SH} WHERE s_id IN (SELECT s_id FROM m WHERE s_id IS NOT NULL)")(lambda spark, sf: frame(spark, sf, "sheets").join(matched(spark, sf, "sheets", "s_id", ["key1", "key2"]), "s_id", "left_semi").select("s_id"))

TI = sql("titles")


SIGNED = "CASE length(title) % 3 WHEN 0 THEN replace(title, ' ', ', ') WHEN 1 THEN concat('(', replace(title, ' ', ')('), ')') ELSE title END"
WHOLE = r"regexp_matches(lower(title), '\b' || regexp_replace(lower(modele), '([-.+()])', '\\\1', 'g') || '\b')"
WITH_LONG = "SELECT DISTINCT modele FROM (SELECT modele FROM {} UNION ALL SELECT 'Rover Sport V8 Long Edition')"


@query("c5_longest_model", f"SELECT title, first(modele ORDER BY length(modele) DESC, modele) AS modele FROM (SELECT DISTINCT {SIGNED} AS title FROM {TI} UNION ALL SELECT 'Land Rover Sport V8 Long Edition, 2019') t JOIN ({WITH_LONG.format(V)}) m ON {WHOLE} GROUP BY title")
def c5(spark, sf):
    """Titles with blanks, commas and brackets, and one model of five words."""
    titles = rows.different(frame(spark, sf, "titles"), "title").select(F.expr(SIGNED).alias("title")).union(spark.createDataFrame([("Land Rover Sport V8 Long Edition, 2019",)], "title string"))
    models = frame(spark, sf, "vehicles").select("modele").union(spark.createDataFrame([("Rover Sport V8 Long Edition",)], "modele string")).distinct()
    return M.longest_model(titles.withColumn("t", F.col("title")), models, "title", "t", "modele")


STATS = f"""(SELECT lower(trim(marque)) AS b, lower(modele) AS m, s_id, coalesce(score, 0) * 2 AS note,
 string_split(pros, ';')[1:3] AS pros, string_split(cons, ';')[1:3] AS cons, string_split(notes, ';')[1:2] AS faults FROM {SH})"""
FOUND = f"""(SELECT lb, lm, s_id, note, pros, cons, faults FROM (SELECT DISTINCT lower(trim(marque)) AS lb, lower(modele) AS lm FROM {LI}) q
 JOIN {STATS} s ON s.b = lb AND starts_with(s.m, lm) QUALIFY row_number() OVER (PARTITION BY lb, lm ORDER BY note DESC, s_id) = 1)"""
C6 = f"""SELECT external_id, s_id, note, array_to_string(pros, ';') AS pros, array_to_string(cons, ';') AS cons, array_to_string(faults, ';') AS faults
FROM {LI} l JOIN {FOUND} h ON h.lb = lower(trim(l.marque)) AND h.lm = lower(l.modele)"""


@query("c6_listing_stats", C6)
def c6(spark, sf):
    """Listings with note, three pros and cons and two faults of the best sheet of the brand whose model begins as theirs."""
    few = lambda c, n: F.slice(F.split(c, ";"), 1, n).alias(c)
    analysis = F.struct(F.coalesce(F.col("score"), F.lit(0.0)).alias("score"), (-F.col("s_id")).alias("order"), few("pros", 3), few("cons", 3), few("notes", 2))
    stats = frame(spark, sf, "sheets").select(F.lower(F.trim("marque")).alias("b"), F.lower("modele").alias("m"), analysis.alias("best"))
    asked = frame(spark, sf, "listings").select("external_id", F.lower(F.trim("marque")).alias("lb"), F.lower("modele").alias("lm"))
    out = asked.join(M.first_beginning(asked, stats, "lb", "lm", "b", "m", "best"), ["lb", "lm"])
    lists = [F.array_join(f"best.{c}", ";").alias(n) for c, n in (("pros", "pros"), ("cons", "cons"), ("notes", "faults"))]
    return out.select("external_id", (-F.col("best.order")).alias("s_id"), (F.col("best.score") * 2).alias("note"), *lists)


LOOK = f"(SELECT DISTINCT {norm('marque')} AS b, CASE WHEN k % 3 = 0 THEN 'golf' WHEN k % 3 = 1 THEN {norm('modele')} ELSE 'inconnu' END AS m FROM {LI})"
BASE = f"(SELECT vehicle_id, {norm('marque')} AS vb, {norm('modele')} AS vm, vehicle_id % 21 AS note FROM {V})"
C8 = f"""WITH q AS {LOOK}, v AS {BASE},
h AS (SELECT b, m, CASE WHEN vehicle_id IS NULL THEN 4 WHEN vm = m THEN 1 WHEN contains(vm, m) THEN 2 ELSE 3 END AS step, note, vehicle_id FROM q LEFT JOIN v ON vb = b)
SELECT b, m, step, vehicle_id FROM h QUALIFY row_number() OVER (PARTITION BY b, m ORDER BY step, note DESC, vehicle_id) = 1"""


@query("c8_stepwise_lookup", C8)
def c8(spark, sf):
    name = F.when(F.col("k") % 3 == 0, "golf").when(F.col("k") % 3 == 1, T.normalize(F.col("modele"))).otherwise("inconnu")
    asked = frame(spark, sf, "listings").select(T.normalize(F.col("marque")).alias("b"), name.alias("m"))
    v = frame(spark, sf, "vehicles").select("vehicle_id", T.normalize(F.col("marque")).alias("vb"), T.normalize(F.col("modele")).alias("vm"), (F.col("vehicle_id") % 21).alias("note"))
    return M.stepwise_lookup(asked, v, "b", "m", "vb", "vm", "note", "vehicle_id")


C9 = f"SELECT DISTINCT l.b, l.m AS a, s.m AS b2 FROM (SELECT lower(trim(marque)) AS b, lower(modele) AS m FROM {LI}) l JOIN (SELECT lower(trim(marque)) AS b, lower(modele) AS m FROM {SH}) s USING (b)"
C9 = f"""WITH RECURSIVE {indel(f'SELECT a, b2 AS b FROM ({C9})')}
SELECT x.b, x.a AS m, min(s_id) AS s_id FROM ({C9}) x JOIN f ON f.a = x.a AND f.b = x.b2 AND ratio >= 50 JOIN {SH} s ON lower(trim(s.marque)) = x.b AND lower(s.modele) = x.b2 GROUP BY ALL"""


@query("c9_fuzzy_notes", C9)
def c9(spark, sf):
    """The first note whose model name in the brand is at least half alike."""
    asked = frame(spark, sf, "listings").select(F.lower(F.trim("marque")).alias("b"), F.lower("modele").alias("m")).distinct()
    notes = frame(spark, sf, "sheets").select(F.lower(F.trim("marque")).alias("b"), F.lower("modele").alias("other"), "s_id")
    return similarity.first_similar(asked, notes, "b", "m", "other", "s_id")


query("c10_without_note", f"SELECT external_id FROM {LI} l WHERE NOT EXISTS (SELECT 1 FROM {RV} r WHERE lower(r.marque) = lower(l.marque) AND r.modele = lower(l.modele) AND r.nb_avis > 10)")(
    lambda spark, sf: frame(spark, sf, "listings").withColumns({"b": F.lower("marque"), "m": F.lower("modele")}).join(frame(spark, sf, "model_reviews").where("nb_avis > 10").select(F.lower("marque").alias("b"), F.col("modele").alias("m")).distinct(), ["b", "m"], "left_anti").select("external_id")
)
C11 = f"SELECT v.marque, v.modele, count(*) AS n FROM (SELECT DISTINCT marque, modele FROM {V}) v JOIN {RE} r ON lower(r.marque) = lower(v.marque) AND contains(lower(r.modele), lower(v.modele)) GROUP BY ALL"


@query("c11_reviews_of_vehicles", C11)
def c11(spark, sf):
    """Reviews of each vehicle's brand whose model holds the vehicle's; counted by name before they are joined."""
    v = frame(spark, sf, "vehicles").select("marque", "modele").distinct().withColumns({"vb": F.lower("marque"), "vm": F.lower("modele")})
    counts = frame(spark, sf, "reviews").groupBy(F.lower("marque").alias("b"), F.lower("modele").alias("m")).agg(F.count("*").alias("c"))
    return M.containing(counts, v, "b", "m", "vb", "vm").groupBy("marque", "modele").agg(F.sum("c").alias("n"))


SEV = f"(SELECT *, CASE WHEN {has('t', R.RECALL_CRITICAL)} THEN 'critical' WHEN {has('t', R.RECALL_SERIOUS)} THEN 'serious' ELSE 'moderate' END AS severity, {has('t', R.RECALL_PENALTY)} AS penal FROM (SELECT *, lower(coalesce(risks, '') || ' ' || coalesce(motive, '')) AS t FROM {RC}))"
VERIFIED = f"(SELECT marque, modele, avg(fiabilite) AS f, count(*) AS n FROM {RE} WHERE level IN ('high', 'medium') GROUP BY ALL HAVING count(*) >= 3)"
RSTAT = f"(SELECT marque, modele, greatest(0.0::DOUBLE, 10.0::DOUBLE - sum(CASE severity WHEN 'critical' THEN 2.0::DOUBLE WHEN 'serious' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)) AS s FROM {SEV} GROUP BY ALL)"


@query("c12_blend_reliability", dbl(f"SELECT v.marque, v.modele, round(CASE WHEN r.f IS NOT NULL AND s.s IS NOT NULL THEN 0.7 * r.f + 0.3 * s.s ELSE coalesce(s.s, r.f, 7.0) END, 3) AS fiabilite FROM (SELECT DISTINCT marque, modele FROM {V}) v LEFT JOIN {VERIFIED} r USING (marque, modele) LEFT JOIN {RSTAT} s USING (marque, modele)"))
def c12(spark, sf):
    reviews = frame(spark, sf, "reviews").where("level in ('high', 'medium')").groupBy("marque", "modele").agg(F.avg("fiabilite").alias("f"), F.count("*").alias("n")).where("n >= 3")
    rec = frame(spark, sf, "recalls").withColumn("sev", T.recall_severity(F.col("risks"), F.col("motive")))
    impact = F.sum(F.when(F.col("sev") == "critical", 2.0).when(F.col("sev") == "serious", 1.0).otherwise(0.5))
    rec = rec.groupBy("marque", "modele").agg(F.greatest(F.lit(0.0), 10.0 - impact).alias("s"))
    v = frame(spark, sf, "vehicles").select("marque", "modele").distinct()
    return M.blend_reliability(v, reviews, rec, ["marque", "modele"], "f", "s")


RISK = values([(k, k.split("_")[0], s, a, b, ",".join(k.split("_")[1:]), R.SEVERITY_RANK[s], R.SEVERITY_MALUS[s]) for k, s, a, b in R.RISKS], "r(risk, brand, severity, first, last, tokens, rk, malus)")
risk_sql = lambda order: f"SELECT external_id, string_agg(risk, ',' ORDER BY risk) AS risks, arg_max(severity, {order}) AS severity, arg_max(malus, {order}) AS malus FROM {LI} l JOIN {RISK} ON brand = CASE WHEN lower(trim(marque)) = 'volkswagen' THEN 'vw' ELSE lower(trim(marque)) END AND year >= first AND year < last AND len(list_filter(string_split(tokens, ','), lambda t: contains(lower(engine), t))) > 0 GROUP BY external_id"
query("c13_engine_risks", risk_sql("rk"))(lambda spark, sf: M.risks(frame(spark, sf, "listings"), M.risk_table(spark), "external_id", F.col("marque"), F.col("year"), F.col("engine")))
query("c13_engine_risks_by_name", risk_sql("severity"))(lambda spark, sf: M.risks(frame(spark, sf, "listings"), M.risk_table(spark), "external_id", F.col("marque"), F.col("year"), F.col("engine"), reference_order=True))


@query("c14_year_overlap", f"SELECT l.k, count(*) AS n FROM (SELECT DISTINCT k, marque, year FROM {LI}) l JOIN {V} v ON v.marque = l.marque AND v.annee_debut <= l.year + 1 AND (v.annee_fin IS NULL OR v.annee_fin >= l.year - 1) GROUP BY l.k")
def c14(spark, sf):
    asked = frame(spark, sf, "listings").select("k", "marque", "year").distinct()
    spans = frame(spark, sf, "vehicles").groupBy("marque", "annee_debut", "annee_fin").agg(F.count("*").alias("c"))
    pair = asked.select("marque", "year").distinct().join(spans, "marque").where("annee_debut <= year + 1 and (annee_fin is null or annee_fin >= year - 1)").groupBy("marque", "year").agg(F.sum("c").alias("n"))
    return asked.join(pair, ["marque", "year"]).select("k", "n")


REP = values([(k, *map(float, v)) for k, v in R.REPUTATIONS.items()], "r(b, f, c, u, s, h)")


@query("c15_brand_reputation", dbl(f"SELECT vehicle_id, coalesce(f, 6.0) AS fiabilite, coalesce(s, 6.5) AS securite, round((coalesce(f, 6.0) * 0.4 + coalesce(c, 6.0) * 0.2 + coalesce(u, 6.0) * 0.2 + coalesce(s, 6.5) * 0.1 + coalesce(h, 6.5) * 0.1) * 2, 1) AS note FROM {V} LEFT JOIN {REP} ON b = lower(marque)"))
def c15(spark, sf):
    get = lambda i: T.lookup({k: v[i] for k, v in R.REPUTATIONS.items()}, F.lower("marque"), F.lit(R.DEFAULT_REPUTATION[i]))
    return frame(spark, sf, "vehicles").select("vehicle_id", get(0).alias("fiabilite"), get(3).alias("securite"), Sc.final_note(*map(get, range(5))).alias("note"))


EST = values([(k, *v) for k, v in R.ESTIMATE_ADJUSTMENTS.items()], "a(b, f, c, p, h, q)")


@query("c16_brand_estimates", dbl(f"SELECT vehicle_id, " + ", ".join(f"greatest(0, least(10, 7.0 + coalesce({x}, 0.0))) AS {n}" for x, n in zip("fcphq", ("fiabilite", "confort", "comportement", "habitabilite", "finition"), strict=True)) + f" FROM {V} LEFT JOIN {EST} ON b = lower(marque)"))
def c16(spark, sf):
    names = ("fiabilite", "confort", "comportement", "habitabilite", "finition")
    return frame(spark, sf, "vehicles").select("vehicle_id", *[Sc.clamp(7.0 + T.lookup({k: v[i] for k, v in R.ESTIMATE_ADJUSTMENTS.items()}, F.lower("marque"), F.lit(0.0))).alias(n) for i, n in enumerate(names)])


SEGMENTS = {"audi": "Premium", "bmw": "Premium", "mercedes_benz": "Premium", "dacia": "Budget", "tesla": "Premium Electric", "alfa_romeo": "Luxury/Sport", "volvo": "Premium SUV"}
WEIGHTS = {"Volume": (0.3, 0.3, 0.15, 0.1, 0.05, 0.1, None), "Premium": (0.25, 0.15, 0.2, 0.15, 0.15, 0.1, None), "Budget": (0.3, 0.4, 0.1, 0.1, 0.0, 0.1, None), "Luxury_Sport": (0.2, 0.1, 0.15, 0.1, 0.3, 0.15, None), "Electric_First": (0.2, 0.2, 0.1, 0.15, 0.1, 0.1, 0.15)}


def segmented(df):
    """Raw and weighted segment; brands and weights are tables of the caller."""
    key = F.translate(F.lower(F.trim("marque")), "- ", "__")
    raw = T.lookup(SEGMENTS, key, F.lit("Volume"))
    return df.withColumn("segment", raw).withColumn("weights_of", F.coalesce(F.when(F.translate("segment", " +", "__").isin(*WEIGHTS), F.translate("segment", " +", "__")), T.lookup(R.SEGMENT_ALIASES, F.col("segment")), F.lit("Volume")))


SEG = values(list(SEGMENTS.items()), "g(b, seg)")
ALI = values(list(R.SEGMENT_ALIASES.items()), "z(a, t)")
SEGSQL = f"(SELECT q.*, CASE WHEN replace(replace(segment, ' ', '_'), '+', '_') IN ('Volume', 'Premium', 'Budget', 'Luxury_Sport', 'Electric_First') THEN replace(replace(segment, ' ', '_'), '+', '_') ELSE coalesce(t, 'Volume') END AS weights_of FROM (SELECT v.*, coalesce(seg, 'Volume') AS segment FROM {V} v LEFT JOIN {SEG} ON b = replace(replace(lower(trim(marque)), '-', '_'), ' ', '_')) q LEFT JOIN {ALI} ON a = segment)"
query("c17_segment_weights", f"SELECT vehicle_id, segment, weights_of FROM {SEGSQL}")(lambda spark, sf: segmented(frame(spark, sf, "vehicles")).select("vehicle_id", "segment", "weights_of"))


def named(table: str) -> str:
    return f"SELECT DISTINCT lower(trim(marque)) AS b, lower(marque) || ' ' || lower(modele) AS name FROM {table}"


GRAMS = "unnest(list_distinct(list_transform(range(1, greatest(length(name), 1) + 1), lambda i: (' ' || name || ' ')[i:i + 2])))"
COSINES = f"""a AS MATERIALIZED ({named(V)}), k AS MATERIALIZED ({named(SH)}), kg AS MATERIALIZED (SELECT b, name AS other, {GRAMS} AS g FROM k), ag AS MATERIALIZED (SELECT b, name, {GRAMS} AS g FROM a),
 w AS MATERIALIZED (SELECT g, pow(ln(((SELECT count(DISTINCT name) FROM k) + 1)::DOUBLE / (count(DISTINCT other) + 1)), 2) AS w FROM kg GROUP BY g),
 kn AS MATERIALIZED (SELECT b, other, sqrt(sum(w)) AS n FROM kg JOIN w USING (g) GROUP BY ALL), an AS MATERIALIZED (SELECT b, name, sqrt(sum(w)) AS n FROM ag JOIN w USING (g) GROUP BY ALL),
 c AS MATERIALIZED (SELECT b, name, other, round(coalesce(sum(w) / nullif(an.n * kn.n, 0), 0), 9) AS cosine FROM ag JOIN kg USING (b, g) JOIN w USING (g) JOIN an USING (b, name) JOIN kn USING (b, other) GROUP BY b, name, other, an.n, kn.n)"""


def names(spark, sf):
    """Different names of vehicles and of sheets, with brand and model, by brand."""
    name = F.concat_ws(" ", F.lower("marque"), F.lower("modele"))
    asked = frame(spark, sf, "vehicles").select(F.lower(F.trim("marque")).alias("b"), name.alias("name")).distinct()
    return asked, frame(spark, sf, "sheets").select(F.lower(F.trim("marque")).alias("b"), name.alias("other"), "s_id")


@query("c19_trigram_cosine", f"WITH {COSINES} SELECT b, name, other, cosine FROM c QUALIFY row_number() OVER (PARTITION BY b, name ORDER BY cosine DESC, other) <= 5")
def c19_cosine(spark, sf):
    """The first stage alone, with the five nearest names."""
    asked, known = names(spark, sf)
    return similarity.cosine_top(asked, known, "b", "name", "b", "other", 5)


C19 = f"""WITH RECURSIVE {COSINES}, top AS MATERIALIZED (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY b, name ORDER BY cosine DESC, other) <= 200),
 h AS (SELECT b, other, min(s_id) AS s_id FROM (SELECT lower(trim(marque)) AS b, lower(marque) || ' ' || lower(modele) AS other, s_id FROM {SH}) GROUP BY ALL),
 {token_sets('SELECT name AS m, other FROM top')}
SELECT b, name, s_id, round(token_set, 3) AS ratio, CASE WHEN token_set >= 92 THEN 'auto' WHEN token_set >= 85 THEN 'probable' ELSE 'reject' END AS status
FROM top JOIN h USING (b, other) JOIN token_sets t ON t.m = name AND t.other = top.other QUALIFY row_number() OVER (PARTITION BY b, name ORDER BY token_set DESC, cosine DESC, s_id) = 1"""


@query("c19_two_stage_match", C19)
def c19(spark, sf):
    """Block, trigram TF-IDF, token-set ratio."""
    asked, known = names(spark, sf)
    return similarity.two_stage(asked, known, "b", "name", "other", "s_id").select("b", "name", "s_id", F.round("ratio", 3).alias("ratio"), "status")


E1 = f"SELECT v.marque, v.modele, min(s_id) AS s_id FROM {V} v JOIN {SH} s ON lower(s.marque) = lower(v.marque) AND contains(lower(s.modele), lower(v.modele)) GROUP BY ALL"


@query("e1_first_match", E1)
def e1(spark, sf):
    v = frame(spark, sf, "vehicles").select("marque", "modele").distinct().withColumns({"vb": F.lower("marque"), "vm": F.lower("modele")})
    sheets = frame(spark, sf, "sheets").select(F.lower("marque").alias("b"), F.lower("modele").alias("m"), "s_id")
    return v.join(M.first_containing(v, sheets, "vb", "vm", "b", "m", "s_id"), ["vb", "vm"]).select("marque", "modele", "s_id")


query("e2_keep_first", f"SELECT vehicle_id, marque, modele FROM {V} QUALIFY row_number() OVER (PARTITION BY marque, modele ORDER BY vehicle_id) = 1")(lambda spark, sf: rows.keep_first(frame(spark, sf, "vehicles").select("vehicle_id", "marque", "modele"), ["marque", "modele"], ["vehicle_id"]))
query("e3_last_write", f"SELECT s_id, marque, modele, score FROM {SH} QUALIFY row_number() OVER (PARTITION BY marque, modele ORDER BY s_id DESC) = 1")(lambda spark, sf: rows.last_write(frame(spark, sf, "sheets").select("s_id", "marque", "modele", "score"), ["marque", "modele"], ["s_id"]))
query("e4_segment_rank", f"SELECT external_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank FROM {LI} WINDOW w AS (PARTITION BY marque ORDER BY expert DESC NULLS LAST)")(
    lambda spark, sf: rows.segment_ranks(frame(spark, sf, "listings").select("external_id", "marque", "expert"), "marque", "expert").select("external_id", F.col("rank").cast("long"), F.col("dense_rank").cast("long"), "percent_rank")
)
query("e5_best_and_worst", f"SELECT vehicle_id, carburant, side FROM (SELECT vehicle_id, carburant, 'best' AS side FROM {V} QUALIFY row_number() OVER (PARTITION BY carburant ORDER BY prix DESC, vehicle_id) <= 5 UNION ALL SELECT vehicle_id, carburant, 'worst' FROM {V} QUALIFY row_number() OVER (PARTITION BY carburant ORDER BY prix, vehicle_id) <= 5)")(
    lambda spark, sf: rows.cap(frame(spark, sf, "vehicles"), ["carburant"], [F.desc("prix"), "vehicle_id"], 5).withColumn("side", F.lit("best")).unionByName(rows.cap(frame(spark, sf, "vehicles"), ["carburant"], ["prix", "vehicle_id"], 5).withColumn("side", F.lit("worst"))).select("vehicle_id", "carburant", "side")
)
query("e6_cap_by_source", f"SELECT source, external_id FROM {LI} QUALIFY row_number() OVER (PARTITION BY source ORDER BY scraped_at DESC, external_id, price) <= 100")(lambda spark, sf: rows.cap(frame(spark, sf, "listings"), ["source"], [F.desc("scraped_at"), "external_id", "price"], 100).select("source", "external_id"))

query("g1_union_sources", f"SELECT source, external_id, price, expert FROM (SELECT source, external_id, price, NULL::DOUBLE AS expert FROM {LI} WHERE source = 'A' UNION ALL SELECT source, external_id, NULL::DOUBLE, expert FROM {LI} WHERE source <> 'A')")(
    lambda spark, sf: frame(spark, sf, "listings").where("source = 'A'").select("source", "external_id", "price").unionByName(frame(spark, sf, "listings").where("source <> 'A'").select("source", "external_id", "expert"), allowMissingColumns=True)
)
