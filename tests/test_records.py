"""Records of whole JSON files, read in ranges of a few bytes, against the same files read by Python."""

import json
import random

import pytest

from autolot.sources import records


@pytest.fixture(params=["67", "100000000"])
def ranges(request, spark):
    """Bytes of a range."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


TEXTS = ["", "a", "b}c", "{x", '"', "\\", '\\"}', "]}, {", "é{ü}", "[[", 'q"}"{"', "zeile\nzwei", "\\\\}", "x" * 90]


def rows(n, seed):
    draw = random.Random(seed)
    return [{"n": i, "t": draw.choice(TEXTS) + draw.choice(TEXTS), "deep": {"x": {"y": draw.choice(TEXTS)}, "l": [{"z": 1}, {"z": draw.choice(TEXTS)}][: draw.randrange(3)]}} for i in range(n)]


SCHEMA = "n bigint, t string, deep struct<x: struct<y: string>>"


def plain(found):
    return sorted((r["n"], r["t"], r["deep"]["x"]["y"]) for r in found)


def write(path, texts, encoding="utf-8"):
    path.mkdir()
    for i, text in enumerate(texts):
        (path / f"{i}.json").write_text(text, encoding=encoding)
    return str(path)


def test_lists_and_objects(spark, tmp_path, ranges):
    a, b, c = rows(40, 1), rows(7, 2), rows(1, 3)[0]
    path = write(tmp_path / "d", [json.dumps(a), "﻿" + json.dumps(b, indent=2, ensure_ascii=False) + "\n", json.dumps(c, indent=1), "[]", "", "[1, null, \"{\"]"])
    assert plain(r.asDict(True) for r in records.read_records(spark, path, SCHEMA).collect()) == plain([*a, *b, c])


def test_pages_pick_their_list(spark, tmp_path, ranges):
    a, b, other = rows(25, 4), rows(3, 5), rows(9, 6)
    texts = [
        json.dumps({"total_count": 25, "results": a, "facets": other}),
        json.dumps({"facets": other, "meta": {"u": {"v": {"w": 1}}}, "results": b, "none": []}, indent=3),
        json.dumps({"facets": other, "results": []}),
        json.dumps([{"results": b}, {"results": a, "facets": other}]),
    ]
    path = write(tmp_path / "d", texts[:3])
    assert plain(r.asDict(True) for r in records.read_records(spark, path, SCHEMA, "results").collect()) == plain([*a, *b])
    path = write(tmp_path / "e", texts[3:])
    assert plain(r.asDict(True) for r in records.read_records(spark, path, SCHEMA, "results").collect()) == plain([*a, *b])


def test_latin_letters(spark, tmp_path, ranges):
    a = rows(20, 7)
    path = write(tmp_path / "d", [json.dumps({"annonces": a}, ensure_ascii=False, indent=2)], "latin-1")
    found = records.transcode(spark, path, str(tmp_path / "u"), SCHEMA, "annonces")
    assert plain(r.asDict(True) for r in found.collect()) == plain(a)


def test_broken_files_give_nothing(spark, tmp_path, ranges):
    good = rows(5, 8)
    text = json.dumps(good)
    path = write(tmp_path / "d", [text, text[:-1], text[:-1] + ",", text[:-2], text + "]", text.replace('"n": 3', '"n: 3', 1), "{broken", "[\n {broken"])
    assert plain(r.asDict(True) for r in records.read_records(spark, path, SCHEMA).collect()) == plain(good)
    assert records.read_records(spark, write(tmp_path / "e", [""]), SCHEMA).count() == 0


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    path = write(tmp_path / "d", [json.dumps(rows(60, 9))])
    tasks = records.pieces(spark, path).select("block").distinct().count()
    assert tasks > 20 if ranges != "100000000" else tasks == 1


def test_documents_of_one_line_each(spark, tmp_path):
    a, b = rows(6, 10), rows(4, 11)
    path = write(tmp_path / "d", ["\n".join(json.dumps({"results": x}, ensure_ascii=False) for x in (a, b)) + "\n"], "latin-1")
    found = records.transcode(spark, path, str(tmp_path / "u"), SCHEMA, "results")
    assert plain(r.asDict(True) for r in found.collect()) == plain([*a, *b])
    path = write(tmp_path / "e", ["\n".join([json.dumps({"results": a}), json.dumps({"results": b})])] + ["{broken\n" + json.dumps({"results": a})])
    assert plain(r.asDict(True) for r in records.read_pages(spark, path, SCHEMA).collect()) == plain([*a, *b])
