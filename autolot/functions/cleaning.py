"""Cleaning of review sentences by ordered rewriting rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from autolot.functions.refdata import STOP_WORDS
from autolot.functions.text import bound

# Fillers to remove, in order.
FILLERS = [
    r"^(bon(jour)?|salut|hello|coucou)[\s,\.!]*", r"^(voilà|en (gros|bref|résumé))[\s,\.!]*", r"^(donc|alors|bref|du coup)[\s,\.!]*",
    r"[\s,\.]*(voilà|bref|en gros)[\s\.!]*$", r"^(pour info|à savoir)[\s:,\.!]*",
    r"^(j'ai|on a) (acheté|pris) (cette|cette voiture|ce|un|une)[\s\w]*[\s,\.]", r"^(ça fait|il y a) \d+ (ans?|mois)[\s\w]*[\s,\.]", r"^(après|depuis) \d+ (km|kilomètres)[\s\w]*[\s,\.]",
]
# Abbreviations, in order.
ABBREVIATIONS = {
    "bcp": "beaucoup", "pb": "problème", "pbs": "problèmes", "qd": "quand", "qq": "quelques", "qqn": "quelqu'un", "qqch": "quelque chose", "tt": "tout", "tjs": "toujours",
    "ns": "nous", "vs": "vous", "pr": "pour", "ac": "avec", "ds": "dans", "ms": "mais", "rdv": "rendez-vous", "cv": "chevaux", "km": "kilomètres", "conso": "consommation",
    "clim": "climatisation", "gps": "GPS", "bva": "boîte automatique", "bvm": "boîte manuelle", "esp": "ESP", "abs": "ABS", "ct": "contrôle technique", "cf": "conforme",
    "pneus": "pneumatiques", "amort": "amortisseurs", "freins": "système de freinage", "embr": "embrayage", "volant": "direction", "sièges": "sièges", "coffre": "volume de coffre",
    "moteur": "motorisation", "boite": "transmission", "suspen": "suspensions",
}
# Emotional wording, in order.
EMOTIONAL = [
    (r"\b(super|trop|vraiment|vachement|carrément|franchement)\s+(bien|bon|content|satisfait|top)\b", "satisfaisant"), (r"\bj'adore\b", "apprécié"), (r"\bje kiffe\b", "apprécié"),
    (r"\bc'est top\b", "satisfaisant"), (r"\bc'est génial\b", "excellent"), (r"\bc'est le feu\b", "performant"), (r"\bau top\b", "de qualité"), (r"\bc'est nul\b", "insuffisant"),
    (r"\bc'est pourri\b", "de mauvaise qualité"), (r"\bc'est de la merde\b", "de très mauvaise qualité"), (r"\bça craint\b", "décevant"), (r"\bj'en peux plus\b", "problématique"),
    (r"\bça me soûle\b", "contraignant"), (r"\bje suis (super |très |vraiment )?(content|satisfait|heureux|ravi)\b", "positif"), (r"\bje suis (super |très |vraiment )?(déçu|mécontent|frustré)\b", "négatif"),
    (r"\bpersonnellement\b", ""), (r"\bà mon avis\b", ""), (r"\bpour moi\b", ""), (r"\bbon après\b", "cependant"), (r"!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{3,}", "..."),
]
# Rewrites of praise and of complaints, in order.
PROS = [
    (r"(ne |)consomme (pas |peu |rien|quasi rien)", "Faible consommation"), (r"(très |super |)économique", "Consommation économique"), (r"pas gourmand(e)?", "Consommation maîtrisée"),
    (r"(très |super |vraiment |)confortable", "Bon niveau de confort"), (r"on est bien (assis|installé)", "Confort des sièges"), (r"silence de roulement", "Insonorisation soignée"),
    (r"(bonne|super) clim", "Climatisation efficace"), (r"(très |super |bien )spacieux", "Habitabilité généreuse"), (r"(grand|gros) coffre", "Volume de coffre important"),
    (r"(beaucoup de |)place (à l'|)arrière", "Places arrière confortables"), (r"(aucun|pas de) (souci|problème|panne)", "Fiabilité exemplaire"), (r"(jamais |)tombé en panne", "Aucune panne signalée"),
    (r"(très |super |)fiable", "Bonne fiabilité"), (r"(solide|robuste)", "Construction robuste"), (r"(sympa|agréable|plaisant) à conduire", "Agrément de conduite"),
    (r"(bonne|super) tenue de route", "Comportement routier sain"), (r"(nerveux|pêchu|dynamique)", "Motorisation réactive"), (r"(direction|volant) précis(e)?", "Direction précise"),
    (r"(pas |peu )cher en entretien", "Coûts d'entretien contenus"), (r"(bonne|super) cote (à la revente)?", "Valeur résiduelle correcte"), (r"(pièces|entretien) pas cher", "Pièces détachées abordables"),
    (r"(belle|jolie|super) (gueule|ligne|allure)", "Design réussi"), (r"(finition|intérieur) (soigné|quali|qualité)", "Finition de qualité"),
]
CONS = [
    (r"(consomme|boit) (beaucoup|pas mal|trop)", "Consommation élevée"), (r"(très |super |)gourmand(e)?", "Consommation excessive"), (r"(essence|diesel) ça fait mal", "Budget carburant important"),
    (r"(souvent|régulièrement) en panne", "Fiabilité aléatoire"), (r"(problème|souci) (de |d')(\w+)", "Problème de $3 signalé"), (r"(électronique|électrique) capricieu(x|se)", "Électronique perfectible"),
    (r"(rouille|corrosion)", "Sensibilité à la corrosion"), (r"(entretien|réparations?) (cher|coûteux|hors de prix)", "Coûts d'entretien élevés"), (r"(pièces|révision) (chères?|hors de prix)", "Pièces détachées onéreuses"),
    (r"(assurance|taxe) (chère|élevée)", "Fiscalité automobile élevée"), (r"(sièges?|suspension) (dur|ferme|raide)", "Suspensions fermes"), (r"(bruit|bruyant) (moteur|roulement)", "Insonorisation perfectible"),
    (r"(mal|peu) insonorisé", "Isolation phonique à améliorer"), (r"(clim|chauffage) (faible|insuffisant)", "Climatisation à améliorer"), (r"(petit|étroit|étriqué) coffre", "Volume de coffre limité"),
    (r"(peu de|manque de) place (arrière)?", "Habitabilité arrière limitée"), (r"(manque|pas assez) de rangements?", "Rangements insuffisants"), (r"(mou|sous-motorisé|manque de pêche)", "Motorisation juste"),
    (r"(direction|volant) (flou|imprécis)", "Direction peu précise"), (r"(mauvaise|pas terrible) tenue de route", "Comportement routier perfectible"), (r"(boîte|bva) (lente|molle|saccadée)", "Transmission à améliorer"),
]
# Letters of keywords.
LETTERS = "a-zàâäéèêëïîôùûüç"


def _rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda s, r: F.regexp_replace(s, "(?iuU)" + r[0], r[1]), rules, text)


def drop_fillers(text: Column) -> Column:
    return F.trim(_rewrite(text, [(p, "") for p in FILLERS]))


def expand(text: Column) -> Column:
    return _rewrite(text, [(rf"\b{k}\b", v) for k, v in ABBREVIATIONS.items()])


def neutralise(text: Column) -> Column:
    return F.trim(_rewrite(text, EMOTIONAL))


def praise(text: Column) -> Column:
    return _rewrite(text, PROS)


def complaint(text: Column) -> Column:
    return _rewrite(text, CONS)


# Blanks before a sign, a sign with a letter right after it, and a sign that ends a text.
BEFORE_SIGN, AFTER_SIGN, LAST_SIGN = r"\s+([.,!?;:])", r"([.,!?;:])([A-Za-zÀ-ÿ])", r"[.!?]\z"


def punctuate(text: Column) -> Column:
    """Single blanks, none before a sign, one after; a capital first and a full stop last."""
    s = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), BEFORE_SIGN, "$1")
    s = F.regexp_replace(s, AFTER_SIGN, "$1 $2")
    s = bound(s, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    return bound(s, lambda x: F.trim(F.when((x != "") & ~x.rlike(LAST_SIGN), F.concat(x, F.lit("."))).otherwise(x)))


def clean(text: Column, pro: bool = True) -> Column:
    """All rules in order; null, and what is shorter than ten characters in the end, gives the empty text."""
    s = neutralise(expand(drop_fillers(F.trim(F.coalesce(text, F.lit(""))))))
    return bound(punctuate(praise(s) if pro else complaint(s)), lambda x: F.when(F.length(x) < 10, "").otherwise(x))


def keywords(text: Column) -> Column:
    """Different words of three letters or more that are no stop words."""
    words = F.filter(F.split(F.lower(text), f"[^{LETTERS}]+"), lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def distinct_items(items: Column, most: float = 0.6) -> Column:
    """Items in order, without those of which more than `most` of the smaller keyword set is shared with one kept before; without those that have no keyword."""
    none = F.array().cast("array<struct<it:string,kw:array<string>>>")

    def step(kept: Column, item: Column) -> Column:
        kw = keywords(item)
        near = F.exists(kept, lambda k: F.size(F.array_intersect(kw, k["kw"])) > most * F.least(F.size(kw), F.size(k["kw"])))
        return F.when((F.size(kw) == 0) | near, kept).otherwise(F.concat(kept, F.array(F.struct(item.alias("it"), kw.alias("kw")))))

    return F.transform(F.aggregate(items, none, step), lambda k: k["it"])
