"""Inputs of the queries, lifted from the given tables.

A lift is a table and expressions that Spark SQL and plain SQL both read alike; so it stands in a query
(`frame`) and in its SQL (`sql`) from one source, while the operators on top are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BRANDS = ["Peugeot", "Renault", "Citroën", "VW", "Audi", "BMW", "Mercedes-Benz", "Toyota", "Ford", "Opel", "Fiat", "Dacia", "Volvo", "Tesla", "Alfa Romeo", " kia "]
MODELS = ["208", "3008", "Clio", "Golf", "X3", "Yaris", "Kangoo", "Model 3", "C3", "Duster", "Focus", "508", "Mégane", "e-208"]
ENGINES = ["1.2 PureTech", "1.5 dCi", "2.0 HDi", "1.4 TSI", "1.0 EcoBoost", "2.0d N47", "1.2 TCe", "électrique"]
PROS = ["Confort de conduite", "tenue de route et direction", "Silence à bord", "bon freinage, airbags", "coffre"]
CONS = ["Suspensions fermes", "bruit moteur", "consommation", "Habitabilité arrière"]
ITEMS = [
    "bonjour, consommation un peu forte", "c'est top ce vehicule, super bien fini", "bcp de place dans le coffre!!", "tres confortable et solide", "pb de boite en hiver", "je kiffe le moteur , il est nerveux",
    "consomme beaucoup en ville", "rouille sur les portes", "donc pas cher en entretien", "ok", "grand coffre , bonne tenue de route", "souvent en panne ... bref", "mou en reprise", "manque de rangements",
]
MOTIVES = ["risque d'incendie du faisceau", "rupture de la direction", "étiquette illisible", "airbag défectueux", "accident possible"]


def case(key: str, values: list[str | None]) -> str:
    """A choice of text by the remainder of a key."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


def div(key: str, n: int) -> str:
    return f"CAST(floor(({key}) / {n}) AS BIGINT)"


def model(key: str) -> str:
    return case(div(key, len(BRANDS)), MODELS)


def number(x: str, unless: str | None = None) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN {unless} THEN NULL ELSE {x} END" if unless else x


K, L, E, O = "p_partkey", "(l_partkey + l_linenumber)", "(user_id + event_id)", "(o_custkey + o_orderkey)"  # noqa: E741
LIFTS: dict[str, tuple[str, dict[str, str]]] = {
    # A label file: text columns, decimal commas, odd values.
    "labels_csv": ("part", {
        "n": K, "lib_mrq": case(K, [*(b.lower() for b in BRANDS), "nan", "", None]), "lib_mod_doss": f"CASE WHEN {K} % 23 = 0 THEN '' ELSE ' ' || {model(K)} || ' ' END",
        "dscom": f"CASE WHEN {K} % 9 = 0 THEN NULL ELSE upper({model(K)}) || ' ' || {case(K, ENGINES[:7])} || ' (' || CAST(60 + 3 * p_size AS VARCHAR(9)) || 'ch)' END",
        "puiss_max": f"CASE WHEN {K} % 7 = 0 THEN NULL WHEN {K} % 11 = 0 THEN 'abc' ELSE CAST(40 + 2 * p_size AS VARCHAR(9)) || ',5' END", "puiss_fisc": f"CAST(4 + {K} % 9 AS VARCHAR(9))",
        "cod_cbr": case(K, ["ES", " go ", "EL", "ELEC+ESSENC HR", "EH", None, "GPL", "XX", "GN", "Gazole"]), "conso_mixte": f"CASE WHEN {K} % 11 = 0 THEN '' ELSE CAST(3 + {K} % 7 AS VARCHAR(9)) || ',' || CAST({K} % 10 AS VARCHAR(9)) END",
        "co2": f"CASE WHEN {K} % 13 = 0 THEN '12,5' ELSE CAST(80 + {K} % 150 AS VARCHAR(9)) END", "boite": case(K, ["A", "M", "BVA auto", "manuelle 5", "cvt", None, "z", "robotisee"]), "tvv": case(K, ["  ", "M10ABCVP0001A123456789XYZ", None, " 12AB "]),
        "annee": case(K, ["2018", "1985", "2031", None, "2022", "abc"]),
    }),
    "vehicles": ("part", {
        "vehicle_id": K, "marque": case(K, BRANDS), "modele": model(K), "designation": f"upper({model(K)}) || ' ' || {case(K, ENGINES)} || ' (' || CAST(60 + 3 * p_size AS VARCHAR(9)) || 'ch)'",
        "puissance": "60 + 3 * p_size", "carburant": case(K, ["essence", "diesel", "electrique", "hybride", "hybride_rechargeable", "gpl", "inconnu"]), "boite": case(K, ["automatique", "manuelle", "inconnu"]),
        "conso": number(f"3 + {K} % 70 * 0.1", f"{K} % 11 = 0"), "co2": number(f"{K} % 17 * 15"), "annee_debut": f"CAST(2000 + {K} % 24 AS INT)", "annee_fin": f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE CAST(2003 + {K} % 24 AS INT) END", "prix": "p_retailprice * 10",
    }),
    "sheets": ("part", {
        "s_id": K, "marque": f"CASE WHEN {K} % 3 = 0 THEN {case(K, BRANDS)} ELSE upper({case(K, BRANDS)}) END", "modele": f"CASE WHEN {K} % 5 = 0 THEN {model(K)} || ' II' ELSE {model(K)} END", "score": number(f"5 + {K} % 40 * 0.1", f"{K} % 10 = 0"), "faults": f"CAST({K} % 13 AS INT)", "engine_faults": f"CAST({K} % 4 AS INT)", "gearbox_faults": f"CAST({K} % 3 AS INT)",
        "pros": case(K, ["Confort de conduite;coffre", "", "tenue de route et direction;Silence à bord;coffre", "bon freinage, airbags"]), "cons": case(K, ["Suspensions fermes", "bruit moteur;consommation;Habitabilité arrière", ""]), "notes": case(K, ["12;14.5;8", "", "7"]), "sales": case(K, ["2019:1200;2017:800;2018:950", "", "2020:5"]),
    }),
    "model_reviews": ("part", {
        "r_id": K, "marque": case(K, BRANDS), "modele": f"lower({model(K)})", "nb_avis": f"CAST({K} % 12 AS INT)", "fiabilite": number(f"{K} % 50 * 0.1", f"{K} % 4 = 0"), "confort": number(f"{K} % 55 * 0.1"), "securite": number(f"{K} % 47 * 0.1", f"{K} % 6 = 0"), "habitabilite": number(f"{K} % 43 * 0.1"),
    }),
    "listings": ("lineitem", {
        "source": "l_returnflag", "external_id": "CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(9))", "price": "l_extendedprice", "km": "l_quantity * 4000", "year": f"CAST(2000 + {L} % 27 AS INT)", "marque": case(L, BRANDS), "modele": model(L),
        "fuel": case(L, ["essence", "diesel", "electrique", "hybride"]), "gearbox": case(L, ["automatique", "manuelle"]), "scraped_at": "l_shipdate", "expert": number(f"{L} % 20", f"{L} % 9 = 0"), "alerts": f"CAST({L} % 4 AS INT)", "k": L, "engine": case(L, ENGINES),
    }),
    "titles": ("lineitem", {
        "k": "(l_partkey * 8 + l_linenumber)", "title": f"{case(L, BRANDS)} || ' ' || {model(L)} || ' ' || {case(L, ENGINES)} || ' ' || CAST(60 + l_partkey % 150 AS VARCHAR(9)) || {case('l_partkey', ['ch', ' cv', ' chevaux', '-'])} || ' ' || {case('l_linenumber', ['BVA auto', 'boite manuelle', '', 'DSG', 'bvm6'])} || ' ' || {case('l_partkey', ['diesel', 'essence', 'hybride', '', 'plug in hybrid', 'GPL'])} || ' ' || CAST(1995 + l_partkey % 35 AS VARCHAR(9))",
    }),
    "reviews": ("events", {
        "review_id": "event_id", "marque": case(E, BRANDS), "modele": model(E), "fiabilite": number("floor(value) % 11", "event_id % 7 = 0"), "confort": number("floor(value * 3) % 11", "event_id % 5 = 0"), "note": number("floor(value) % 21", "event_id % 3 = 0"),
        "content": case("event_id", ["", "court", "un avis assez long pour passer le seuil de cinquante caracteres, vraiment"]), "km": "CAST(user_id * 1000 AS INT)", "date": case("event_id", ["", "2024-01-02"]), "n_pros": "CAST(event_id % 3 AS INT)", "n_cons": "CAST(event_id % 2 AS INT)",
        "level": case("event_id", ["high", "medium", "low"]), "label": case("event_id", ["Fiabilité", "Confort", "volume de coffre", "Prix"]), "text": case("event_id", ["4,5/5", "16 / 20", "7", "3.5", "18", "25", "sans note", "8/0"]), "author": case("event_id", ["  Jean ", "", None, "Anne"]), "ts": "ts",
    }),
    "recalls": ("orders", {
        "ref": "o_orderkey", "brand_field": case(O, [*BRANDS[:8], "", None]), "product": f"{case(O, BRANDS)} || ' ' || {model(O)} || ' série'", "category": case("o_orderkey", ["automobiles", "alimentation"]), "risks": case("o_orderkey", MOTIVES), "motive": case("o_custkey", [None, "défaillance du frein", "contrôle", "perte de contrôle"]), "shops": case("o_orderkey", ["A, B;C", "", None, "D\nE"]),
        "marque": case(O, BRANDS), "modele": model(O), "ts": "o_orderdate",
    }),
    "fuel_feed": ("events", {"station": "user_id", "name": case("event_id", ["SP95", "SP98", "E10", "Gazole", "E85", "GPLc", "Autre"]), "raw": "CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value * 10) AS INT) AS VARCHAR(12)) END", "ts": "ts"}),
    "items": ("orders", {"owner": "o_custkey", "n": "o_orderkey", "item": f"{case('o_orderkey', ITEMS)} || CASE WHEN o_custkey % 3 = 0 THEN ' vraiment' ELSE '' END"}),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = LIFTS[name]
    expressions = [f"{e} AS `{c}`".replace("VARCHAR(9)", "STRING").replace("VARCHAR(12)", "STRING").replace("VARCHAR(20)", "STRING") for c, e in columns.items()]
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*expressions)


def sql(name: str) -> str:
    base, columns = LIFTS[name]
    return "(SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {base})"
