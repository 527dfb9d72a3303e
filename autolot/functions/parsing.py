"""Column functions that read captured pages: reviews, sheets, listing cards, recall records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from autolot.functions.text import bound, collapse, digits, lookup, pseudonym, suffixed_number


def plain(html: Column) -> Column:
    """A page's text: tags become blanks."""
    return collapse(F.regexp_replace(html, r"<[^>]*>", " "))


def _pick(text: Column, pattern: str, group: int = 1) -> Column:
    return bound(F.regexp_extract(text, pattern, group), lambda x: F.nullif(x, F.lit("")))


def page_score(html: Column, label: str) -> Column:
    """The mean score `label … x/5` of a review page; null if it has none."""
    return F.replace(_pick(plain(html), rf"{label}\s*:?\s*(\d+(?:[.,]\d+)?)\s*/\s*5"), F.lit(","), F.lit(".")).try_cast("double")


def page_reviews(html: Column) -> Column:
    return _pick(plain(html), r"(\d+)\s+avis").try_cast("int")


def leading_int(text: Column) -> Column:
    return _pick(text, r"^(\d+)").try_cast("int")


#: Patterns of a review block and of a sheet's points. Fixed values.
MONTHS = "Janvier|Février|Mars|Avril|Mai|Juin|Juillet|Août|Septembre|Octobre|Novembre|Décembre"
FUELS = "Essence|Diesel|Hybride|Électrique|GPL|E85"
BOXES = "Manuelle|Automatique|Auto|BVA|CVT"
AUTHOR = r"(?U)[Rr]édigé\s+par\s+([^,]+),?\s*(?:en\s+)?(\w+\s+\d{4})?"
ENGINE = r"(?iU)(\d+(?:\.\d+)?[Ll]?\s*-?\s*\d+\s*ch)"
PROS = r"(?isu)Avantages?\s*:?\s*([^I]+?)(?=Inconvénients?|\z)"
CONS = r"(?isu)Inconvénients?\s*:?\s*(.+?)\z"
NO_TITLE = r"(?iu)\d/5|Rédigé|Avantage|Inconvénient"
USERS, SKIPPED = "l'avis des internautes", ("toutes les autres", "signalé")


def block(text: Column) -> Column:
    """note, author (pseudonym), date, vehicle_month, fuel, gearbox, engine, pros, cons and title of a review block.

    The block is the page's text, a line for each element. Pros and cons may have several lines. The pros are lost if
    they hold an i, as in the source, whose pattern stops there.
    """
    t = F.trim(text)
    lines = F.filter(F.transform(F.split(t, r"\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 5) & (F.length(x) < 100) & ~x.rlike(NO_TITLE))
    return F.struct(
        F.coalesce(F.replace(_pick(t, r"(\d+(?:[.,]\d+)?)\s*/\s*5"), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)).alias("note"),
        F.when(t.rlike(AUTHOR), pseudonym(_pick(t, AUTHOR))).alias("author"),
        _pick(t, AUTHOR, 2).alias("date"),
        _pick(t, rf"(?iuU)((?:{MONTHS})\s+\d{{4}})").alias("vehicle_month"),
        F.initcap(_pick(t, f"(?iu)({FUELS})")).alias("fuel"),
        F.initcap(_pick(t, f"(?iu)({BOXES})")).alias("gearbox"),
        _pick(t, ENGINE).alias("engine"),
        F.trim(_pick(t, PROS), F.lit(" \n\t")).alias("pros"),
        F.trim(_pick(t, CONS), F.lit(" \n\t")).alias("cons"),
        F.get(lines, F.lit(0)).alias("title"),
    )


def period(html: Column) -> Column:
    """First and last year of `(yyyy-yyyy)` or `(yyyy-)`."""
    p = r"\((\d{4})-(\d{4})?\)"
    return F.struct(_pick(html, p, 1).try_cast("int").alias("first"), _pick(html, p, 2).try_cast("int").alias("last"))


def url_part(url: Column, n: int) -> Column:
    """A part of a sheet's path: 1 brand, 2 model, 3 number."""
    return _pick(url, r"/fiche/([^/]+)/(.+)-(\d+)\.html", n)


def sheet_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="(/fiche/[^"]+-\d+\.html)"'), 1)


def items(html: Column) -> Column:
    """Texts of list items."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<li>(.*?)</li>"), 1), plain)


def lines_of(html: Column) -> Column:
    """The texts between tags, without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(html, "<[^>]*>", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _section(lines: Column, name: str) -> Column:
    """What the experts (`name`_expert) and what the users say (`name`_user) in a section's lines."""
    def said(x: Column, longer_than: int) -> Column:
        skipped = bound(F.lower(x), lambda low: reduce(lambda a, w: a | low.contains(w), SKIPPED, low.contains(USERS)))
        return (F.length(x) > longer_than) & ~x.rlike(r"^\([^)]+\)$") & ~skipped

    def parted(all_: Column, at: Column) -> Column:
        expert = F.when(at > 0, F.slice(all_, F.lit(1), at - 1)).otherwise(all_)
        user = F.when(at > 0, F.slice(all_, at + 1, F.size(all_))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.filter(expert, lambda x: said(x, 40)).alias(f"{name}_expert"), F.filter(user, lambda x: said(x, 15)).alias(f"{name}_user"))

    users = lambda all_: F.array_position(F.transform(all_, lambda x: F.lower(x).contains(USERS)), True).cast("int")
    return bound(lines, lambda all_: bound(users(all_), lambda at: parted(all_, at)))


def sheet_points(html: Column) -> Column:
    """pros and cons of a sheet, of experts (more than 40 characters) and of users (more than 15).

    The line `Défauts` parts them, and in each the line on the users' opinion parts experts and users. Lines in brackets,
    which name an engine, and those of navigation are skipped.
    """
    def parted(lines: Column, cut: Column) -> Column:
        pros = _section(F.when(cut > 1, F.slice(lines, F.lit(1), cut - 1)).otherwise(lines), "pros")
        cons = _section(F.when(cut > 1, F.slice(lines, cut, F.size(lines))).otherwise(F.array().cast("array<string>")), "cons")
        return bound(F.struct(pros.alias("p"), cons.alias("c")), lambda x: F.struct(*[x[part][f].alias(f) for part, f in (("p", "pros_expert"), ("p", "pros_user"), ("c", "cons_expert"), ("c", "cons_user"))]))

    faults = lambda lines: F.array_position(F.transform(lines, lambda x: F.lower(x).isin("défauts", "defauts")), True).cast("int")
    return bound(lines_of(html), lambda lines: bound(faults(lines), lambda cut: parted(lines, cut)))


def yearly_sales(html: Column) -> Column:
    """(year, sales) by year, from tables with a row of three years or more and a later row of as many numbers (82.1K, 1.2M, 900)."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), plain)
    start = F.struct(F.lit(None).cast("array<string>").alias("years"), F.lit(None).cast("array<string>").alias("sales"))

    def step(state: Column, row: Column) -> Column:
        years = F.size(F.filter(row, lambda x: x.rlike(r"^20\d{2}$"))) >= 3
        numbers = F.size(F.filter(row, lambda x: x.rlike(r"\d"))) >= 3
        fresh = F.struct(row.alias("years"), state["sales"].alias("sales"))
        filled = F.struct(state["years"].alias("years"), row.alias("sales"))
        return F.when(state["sales"].isNotNull(), state).when(years, fresh).when(state["years"].isNotNull() & numbers, filled).otherwise(state)

    def of_table(table: Column) -> Column:
        found = F.aggregate(F.transform(F.regexp_extract_all(table, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1), cells), start, step)
        pairs = F.filter(F.arrays_zip(found["years"].alias("y"), found["sales"].alias("s")), lambda x: x["y"].rlike(r"^20\d{2}$") & x["s"].isNotNull())
        rows = F.transform(pairs, lambda x: F.struct(x["y"].cast("int").alias("year"), suffixed_number(x["s"]).alias("sales")))
        return F.coalesce(F.filter(rows, lambda x: x["sales"] > 0), F.array().cast("array<struct<year:int,sales:bigint>>"))

    return F.sort_array(F.flatten(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<table[^>]*>(.*?)</table>"), 1), of_table)))


def engine_notes(html: Column) -> Column:
    """Engines with their notes; notes above 10 are halved."""
    names, values = (F.regexp_extract_all(html, F.lit(r"<tr><td>([^<]*)</td><td>([\d.,]+)</td></tr>"), i) for i in (1, 2))
    number = F.transform(values, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    return F.transform(F.arrays_zip(names.alias("engine"), number.alias("note")), lambda x: F.struct(x["engine"].alias("engine"), F.when(x["note"] > 10, x["note"] / 2).otherwise(x["note"]).alias("note")))


def attribute(html: Column, name: str) -> Column:
    """The first value of an attribute; null without one or if it is empty. It is found by its place, without a pattern."""
    begin = f'{name}="'
    value = lambda rest: F.when(rest.contains('"'), bound(F.substring_index(rest, '"', 1), lambda x: F.nullif(x, F.lit(""))))
    return bound(F.instr(html, begin), lambda at: F.when(at > 0, bound(F.substr(html, at + len(begin)), value)))


def identifier(found: Column, href: Column) -> Column:
    """An id of the page, else the first 12 characters of the link's MD5."""
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(F.md5(href), 1, 12))


#: Fuel codes of attribute cards. Fixed values.
CARD_FUELS = {"b": "Essence", "d": "Diesel", "e": "Électrique", "l": "GPL", "c": "CNG", "2": "Hybride", "h": "Hybride"}
SITE = "https://www.autoscout24.fr"


def attribute_card(article: Column, site: str = SITE) -> Column:
    """A listing from an <article> whose data attributes hold it; null without an id or a title.

    The title is the heading's first two spans, else make and model; the link counts if it leads to an offer, else one is
    made from the id; the photo is the first of a source's set, else the image's.
    """
    def read(a: Column) -> Column:
        value = lambda name: attribute(a, name)
        make, model = F.initcap(value("data-make")), F.initcap(value("data-model"))
        ident = F.coalesce(value("data-guid"), _pick(a, r'<article[^>]*\sid="([^"]*)"'))
        heading = F.regexp_extract(a, r"(?s)<h[23][^>]*>(.*?)</h[23]>", 1)
        spans = F.transform(F.regexp_extract_all(heading, F.lit(r"(?s)<span[^>]*>(.*?)</span>"), 1), plain)
        photo = F.coalesce(_pick(a, r'<source[^>]*\ssrcset="([^"\s]+)'), _pick(a, r'<img[^>]*\s(?:data-)?src="([^"\s]+)'))
        return bound(F.struct(a.alias("a"), ident.alias("ident"), make.alias("make"), model.alias("model"), spans.alias("spans"), photo.alias("photo"), _pick(a, r'<a(?:\s[^>]*)?\shref="([^"]*)"').alias("href")), titled)

    def titled(x: Column) -> Column:
        first, second = F.get(x["spans"], F.lit(0)), F.get(x["spans"], F.lit(1))
        title = F.when(first.isNotNull(), F.when((second != "") & (second != first), F.concat_ws(" ", first, second)).otherwise(first))
        return bound(F.nullif(F.coalesce(title, F.trim(F.concat_ws(" ", x["make"], x["model"]))), F.lit("")), lambda t: whole(x, t))

    def whole(x: Column, title: Column) -> Column:
        ident, href, value = x["ident"], x["href"], lambda name: attribute(x["a"], name)
        offer = href.contains("/offres/") | href.contains("/annonces/")
        url = F.when(offer, F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href)).otherwise(F.concat(F.lit(f"{site}/offres/-"), ident))
        year = bound(F.split(value("data-first-registration"), "-"), lambda on: F.when(F.size(on) == 2, F.get(on, F.lit(1)).try_cast("int")))
        listing = F.struct(
            ident.alias("external_id"), url.alias("url"), title.alias("title"),
            value("data-price").try_cast("int").alias("price"), value("data-mileage").try_cast("int").alias("mileage"), year.alias("year"),
            lookup(CARD_FUELS, F.lower(value("data-fuel-type"))).alias("fuel"),
            value("data-listing-zip-code").alias("zipcode"), x["photo"].alias("photo_url"), x["make"].alias("brand"), x["model"].alias("model"),
        )
        return F.when(ident.isNotNull() & title.isNotNull(), listing)

    return bound(article, read)


#: Words of link and tag cards. Fixed values.
BADGES = ("a ne pas manquer", "nouveauté", "très bonne affaire", "bonne affaire")
LINK_FUELS = ("diesel", "essence", "électrique", "electrique", "hybride", "hybrides", "gpl")
LINK_BOXES = ("auto", "auto.", "automatique", "manuelle", "manuel")
TAG_FUELS, TAG_BOXES = ("essence", "diesel", "électrique", "hybride", "gpl"), ("manuelle", "automatique", "manuel", "auto")


def _first(parts: Column, test) -> Column:
    return F.get(F.filter(parts, test), F.lit(0))


def _last(parts: Column, test) -> Column:
    return F.try_element_at(F.filter(parts, test), F.lit(-1))


def _gearbox(word: Column) -> Column:
    return F.when(word.isNotNull(), F.when(F.lower(word).contains("auto"), "Automatique").otherwise("Manuelle"))


def link_card(link: Column, brands: list[str], site: str = "https://www.lacentrale.fr") -> Column:
    """A listing from an <a> of text parts, known by their look; null without an advert's link, or without title and price.

    The title is the first part with a known brand. Of badges, fuels and gearboxes the last counts, else the first part.
    """
    branded = lambda x: bound(F.upper(x), lambda up: reduce(lambda a, b: a | up.contains(b), brands, F.lit(False)))

    def read(a: Column, lines: Column) -> Column:
        href, badge = _pick(a, r'<a[^>]*\shref="([^"]*)"'), _last(lines, lambda x: F.lower(x).isin(*BADGES))
        photo = _pick(a, r'<img[^>]*\s(?:data-|data-lazy-)?src="([^"]*)"')
        parts = F.filter(lines, lambda x: ~F.lower(x).isin(*BADGES))
        return bound(F.struct(href.alias("href"), badge.alias("badge"), photo.alias("photo"), parts.alias("parts"), F.transform(lines, F.lower).alias("low")), titled)

    def titled(x: Column) -> Column:
        return bound(_first(x["parts"], branded), lambda title: bound(_first(x["parts"], lambda y: y.contains("€") & ~y.eqNullSafe(title)), lambda price: whole(x, title, price)))

    def whole(x: Column, title: Column, price: Column) -> Column:
        href, parts, low = x["href"], x["parts"], x["low"]  # no fuel and no gearbox is a badge
        km = _first(parts, lambda y: F.lower(y).contains("km") & ~y.eqNullSafe(title) & ~y.eqNullSafe(price))
        listing = F.struct(
            identifier(_pick(href, r"annonce-(\d+)"), href).alias("external_id"), F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href).alias("url"),
            F.coalesce(title, F.lit("Annonce La Centrale")).alias("title"), digits(price).alias("price"), digits(km).alias("mileage"),
            _first(parts, lambda y: y.rlike(r"^20[0-2]\d$")).try_cast("int").alias("year"),
            F.replace(F.initcap(_last(low, lambda y: y.isin(*LINK_FUELS))), F.lit("Hybrides"), F.lit("Hybride")).alias("fuel"),
            bound(_last(low, lambda y: y.isin(*LINK_BOXES)), _gearbox).alias("transmission"),
            x["photo"].alias("photo_url"), F.concat(F.lit("🏷️ "), x["badge"]).alias("description"),
        )
        return F.when(href.contains("auto-occasion-annonce") & (title.isNotNull() | price.isNotNull()), listing)

    return bound(link, lambda a: bound(lines_of(a), lambda lines: read(a, lines)))


def _marked(html: Column, name: str, test: str) -> Column:
    """The text of the element that a card marks as its `name`."""
    found = F.regexp_extract(html, rf'(?s)<(\w++)[^>]*(?:data-qa-id="aditem_{name}"|class="aditem_{name}"|data-test-id="{test}")[^>]*>(.*?)</\1>', 2)
    return bound(plain(found), lambda x: F.nullif(x, F.lit("")))


def tag_card(card: Column, site: str = "https://www.leboncoin.fr") -> Column:
    """A listing from a card of marked elements and tags; null without a title of five characters.

    Year and mileage that no tag tells are taken from the card's whole text. A card without a number in its link gets one
    from its title.
    """
    def read(a: Column) -> Column:
        title = F.coalesce(_marked(a, "title", "ad-subject"), bound(plain(F.regexp_extract(a, r"(?s)<h2[^>]*>(.*?)</h2>", 1)), lambda x: F.nullif(x, F.lit(""))), _pick(a, r'<a[^>]*\stitle="([^"]*)"'))
        return bound(title, lambda t: F.when(F.length(t) >= 5, bound(F.struct(a.alias("a"), t.alias("title"), url(a).alias("url"), tags(a).alias("tags")), whole)))

    def url(a: Column) -> Column:
        return bound(_pick(a, r'<a[^>]*\shref="([^"]*)"'), lambda href: F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href)))

    def tags(a: Column) -> Column:
        found = F.regexp_extract_all(F.regexp_extract(a, r'(?s)(?:data-qa-id|class)="aditem_tags"[^>]*>(.*?)</div>', 1), F.lit(r"(?s)<span[^>]*>(.*?)</span>"), 1)
        return F.transform(found, lambda x: F.lower(plain(x)))

    def whole(x: Column) -> Column:
        a, found = x["a"], x["tags"]
        tagged = F.struct(_last(found, lambda y: y.rlike(r"^20\d{2}$")).try_cast("int").alias("year"), digits(_last(found, lambda y: y.contains("km") & ~y.rlike(r"^20\d{2}$"))).alias("km"))
        text = lambda t: F.when(t["year"].isNull() | t["km"].isNull(), plain(a))
        told = lambda t, p: F.struct(F.coalesce(t["year"], _pick(p, r"\b(20\d{2})\b").try_cast("int")).alias("year"), F.coalesce(t["km"], digits(_pick(p, r"(?i)([\d\s]+)\s*km"))).alias("km"))
        return bound(bound(tagged, lambda t: bound(text(t), lambda p: told(t, p))), lambda t: listing(x, t))

    def listing(x: Column, moved: Column) -> Column:
        a, title, found = x["a"], x["title"], x["tags"]
        return F.struct(
            F.coalesce(_pick(x["url"], r"/(\d+)\.htm"), F.concat(F.lit("lbc_"), (F.crc32(title.cast("binary")) % 100_000_000).cast("string"))).alias("external_id"), F.coalesce(x["url"], F.lit("")).alias("url"), title.alias("title"),
            digits(_marked(a, "price", "ad-price")).alias("price"), _marked(a, "location", "ad-geo").alias("city"),
            moved["year"].alias("year"), moved["km"].alias("mileage"),
            F.initcap(_last(found, lambda y: y.isin(*TAG_FUELS))).alias("fuel"), bound(_last(found, lambda y: y.isin(*TAG_BOXES)), _gearbox).alias("transmission"),
            _pick(a, r'<img[^>]*\s(?:data-)?src="([^"]*)"').alias("photo_url"),
        )

    return bound(card, read)


def _of_class(html: Column, name: str) -> Column:
    """The trimmed text of the first element of a class; empty without one."""
    return plain(F.regexp_extract(html, rf'(?s)<(\w+)[^>]*class="{name}"[^>]*>(.*?)</\1>', 2))


def legacy_card(html: Column, article: Column) -> Column:
    """The twelve columns of a legacy card, all texts; `article` is its detail page, which holds the Crit'Air label."""
    bare = lambda x: F.translate(x, "éèêëÉË", "eeeeEE")
    title = F.split(bare(_of_class(html, "vehicle-model")), " ")
    moving = F.split(_of_class(html, "vehicle-transmission"), " - ")
    year_km = _of_class(html, "vehicle-zero-km")
    options = F.regexp_extract_all(html, F.lit(r'(?s)class="equipment-tooltip-content"[^>]*>(.*?)<'), 1)
    picture, link = _pick(html, r'data-original="([^"]*)"'), _pick(html, r'class="real-link vehicle-info-link"[^>]*href="([^"]*)"')
    label = F.filter(F.transform(F.regexp_extract_all(article, F.lit(r'(?s)class="labels-body"[^>]*>(.*?)<'), 1), plain), lambda x: x.contains("Crit'Air"))
    empty = lambda x: F.coalesce(x, F.lit(""))
    return F.struct(
        empty(F.get(title, F.lit(0))).alias("Marque"), empty(F.get(title, F.lit(1))).alias("Modele"), _of_class(html, "vehicle-motorisation").alias("Sous-titre"),
        empty(F.concat(F.lit("https:"), picture)).alias("Image"), F.regexp_replace(_of_class(html, "vehicle-loa-offer"), "[€\\s\u00a0]", "").alias("Prix"),
        F.when(F.size(moving) > 1, moving[1]).otherwise("").alias("Motorisation"), F.when(F.size(moving) > 1, moving[0]).otherwise("").alias("Carburant"),
        F.substring(year_km, 1, 4).alias("Annee"), F.replace(year_km.substr(F.lit(9), F.greatest(F.length(year_km) - 11, F.lit(0))), F.lit(" "), F.lit("")).alias("Kms"),
        F.transform(options, lambda x: bare(F.trim(x))).alias("Options"), empty(F.concat(F.lit("https://www.aramisauto.com"), link)).alias("Lien"),
        empty(F.replace(F.get(label, F.lit(0)), F.lit("Crit'Air "), F.lit(""))).alias("Crit'air"),
    )


def card(text: Column) -> Column:
    """year, km, price, fuel and gearbox of a card of parts between bullets; parts are known by their look."""
    parts = F.transform(F.split(text, "•"), lambda x: F.trim(x))
    first = lambda test: F.get(F.filter(parts, test), F.lit(0))
    return F.struct(
        digits(first(lambda x: x.rlike("€"))).alias("price"), digits(first(lambda x: x.rlike(r"(?i)\bkm\b"))).alias("km"), first(lambda x: x.rlike(r"^(19|20)\d{2}$")).try_cast("int").alias("year"),
        first(lambda x: x.rlike("(?i)essence|diesel|electrique|hybride|gpl")).alias("fuel"), first(lambda x: x.rlike("(?i)manuelle|automatique")).alias("gearbox"),
    )


def recall_brand(field: Column, product: Column, known: list[str]) -> Column:
    """The brand field, else the first known brand in the product's name, else its first word."""
    up = F.upper(F.coalesce(product, F.lit("")))
    found = reduce(lambda w, b: w.when(up.contains(b), b), known, F).otherwise(F.split(collapse(up), " ")[0])
    return F.coalesce(F.upper(F.nullif(field, F.lit(""))), found)


def recall_model(product: Column) -> Column:
    return F.upper(F.get(F.split(collapse(product), " "), F.lit(1)))


def shops(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;\n]"), lambda x: F.trim(x)), lambda x: x != "")
