"""Pages and cards are worked out once for each row, however many columns are read from them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from autolot import plans
from autolot.functions import parsing as P

READERS = {
    "sheet_points": P.sheet_points,
    "attribute_card": P.attribute_card,
    "link_card": lambda x: P.link_card(x, ["BMW", "AUDI"]),
    "tag_card": P.tag_card,
}


def plan(df):
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


@pytest.mark.parametrize("name", sorted(READERS))
def test_a_page_is_made_once(spark, name):
    """The page is an expression of its own here; as often as it stands in the plan, as often a row's page is made."""
    page = F.reverse(F.concat("h", F.lit("")))
    df = spark.createDataFrame([("x",)], "h string").select(READERS[name](page).alias("c"))
    assert plan(df).count("reverse(") == 1
    assert plan(df.select("c.*")).count("reverse(") == 1


def test_lines_of_a_sheet_and_a_card_are_made_once(spark):
    df = spark.createDataFrame([("x",)], "h string")
    for reader in (P.sheet_points, READERS["link_card"]):
        assert plan(df.select(reader(F.col("h")).alias("c"))).count("<[^>]*>") == 1


def test_the_filter_of_tag_cards_does_not_read_them_again(spark, sf_dir):
    assert plan(plans.queries()["h26_tag_cards"](spark, sf_dir)).count("ad-subject") == 1


def test_sheets_are_dealt_to_all_tasks(spark, sf_dir):
    assert "RepartitionByExpression" in plan(plans.queries()["h23_sheet_points"](spark, sf_dir))


def test_attributes_by_their_place(spark):
    html = '<article x-data-make="a" data-model="" data-price="1" data-price="2" data-guid="'
    df = spark.createDataFrame([(html,), ("",), (None,), ('é€ data-make="ü"',)], "h string")
    got = [tuple(r) for r in df.select(*[P.attribute(F.col("h"), f"data-{n}") for n in ("make", "model", "price", "guid", "x")]).collect()]
    assert got == [("a", None, "1", None, None), (None,) * 5, (None,) * 5, ("ü", None, None, None, None)]


def test_an_article_is_no_link(spark):
    card = '<article href="/offres/9" data-guid="g" data-make="bmw"><a class="x" href="/offres/1">x</a></article>'
    assert spark.createDataFrame([(card,)], "h string").select(P.attribute_card(F.col("h")).alias("c")).first().c.url == "https://www.autoscout24.fr/offres/1"
