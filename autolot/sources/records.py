"""Records of large JSON documents, read by many tasks.

A file that is one document, indented or in one line, is cut at its closing braces, and byte ranges of it go to different tasks. What
a piece means depends on whether it begins within a string and at what depth of nesting. Both are prefix sums: of quotes and of
brackets, first over the ranges of a file, a row each, then over the pieces of a range. A record ends where a brace closes at the
depth of records. Only a record that crosses the end of a range is put together from several.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autolot.sources.files import materialize, small

#: What stands before the first opening brace outside strings.
AHEAD = r'(?s)^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'


def _balance(text: Column, inside: bool) -> Column:
    """Opened less closed brackets outside strings, but for the brace that ends a piece. Escapes are gone from the text."""
    text = F.regexp_replace(text, r'^[^"]*(?:"|\z)', "") if inside else text
    text = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\.", "")


def pieces(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The text before each closing brace, as file, block (the first byte of its range), pos (its order there) and value, with the
    quotes in it and the change of depth if it begins outside (`d_out`) or inside (`d_in`) a string."""
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("pos"), "value")
    bytes_ = F.octet_length("value").cast("long") + 1
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    raw = raw.select("file", "block", "size", "pos", bytes_.alias("bytes"), value.alias("value")).withColumn("bare", _bare(F.col("value")))
    quotes = F.length("bare") - F.length(F.translate("bare", '"', ""))
    raw = raw.withColumn("quotes", quotes.cast("long"))
    out, inside = _balance(F.col("bare"), False) - F.when(F.col("quotes") % 2 == 0, 1).otherwise(0), _balance(F.col("bare"), True) - F.when(F.col("quotes") % 2 == 1, 1).otherwise(0)
    return raw.withColumn("d_out", out.cast("long")).withColumn("d_in", inside.cast("long")).drop("bare")


def _earlier(*by: str, order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _sum(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def blocks(found: DataFrame, key: str | None) -> DataFrame:
    """file, block, parity and depth at the begin of each range, and the level of its file's records. Files that are not balanced
    are left out. A row for each range (128 MB by default)."""
    w = _earlier("file", "block", order="pos")
    inner = found.select("file", "block", "size", "pos", "bytes", "quotes", "d_out", "d_in", F.col("value").rlike(r"^[\s\x{FEFF}]*\[").alias("listed")).withColumn("inside", _sum("quotes", w) % 2)
    even = F.col("inside") == 0
    totals = inner.groupBy("file", "block").agg(
        F.max("size").alias("size"), F.sum("bytes").alias("bytes"), F.sum("quotes").alias("quotes"), F.min_by("listed", "pos").alias("listed"),
        F.sum(F.when(even, F.col("d_out")).otherwise(F.col("d_in"))).alias("d_out"), F.sum(F.when(even, F.col("d_in")).otherwise(F.col("d_out"))).alias("d_in"),
    )
    before, file = _earlier("file", order="block"), Window.partitionBy("file")
    totals = totals.withColumn("parity", _sum("quotes", before) % 2).withColumn("d", F.when(F.col("parity") == 0, F.col("d_out")).otherwise(F.col("d_in")))
    totals = totals.withColumn("depth", _sum("d", before))
    # A last piece without its brace counts one byte and one brace too many (three bytes of a mark of order may be passed over).
    unclosed = F.pmod(F.max("size").over(file) - F.sum("bytes").over(file), F.lit(3)) == 2
    balanced = (F.sum("quotes").over(file) % 2 == 0) & (F.sum("d").over(file) == F.when(unclosed, -1).otherwise(0))
    level = F.min_by("listed", "block").over(file).cast("int") + (2 if key else 0)
    return totals.withColumn("balanced", balanced).withColumn("level", level).where("balanced").select("file", "block", "parity", "depth", "level")


def _text(parts: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), "")


def record_texts(spark: SparkSession, path: str, key: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """The JSON text, as `value`, of each record of documents at `path`: the objects of a document's list, or the document where it
    is an object; with `key`, the objects in the list under that key of the document, or of the objects of its list.

    A file whose quotes or brackets do not match gives no rows; an empty one and an empty list neither. A record may cross
    any number of ranges, and has to fit into a row. Objects in lists within the list are no records and must not stand there.
    """
    found = pieces(spark, path, encoding)
    starts = materialize(blocks(found, key), "json-blocks")
    w = _earlier("file", "block", order="pos")
    p = found.join(small(starts), ["file", "block"]).withColumn("inside", (F.col("parity") + _sum("quotes", w)) % 2)
    p = p.withColumn("d", F.when(F.col("inside") == 0, F.col("d_out")).otherwise(F.col("d_in"))).withColumn("before", F.col("depth") + _sum("d", w)).withColumn("after", F.col("before") + F.col("d"))
    p = p.withColumn("closes", ((F.col("after") == F.col("level")) & ((F.col("inside") + F.col("quotes")) % 2 == 0)).cast("int"))
    p = p.withColumn("record", _sum("closes", w)).withColumn("section", F.lit(None if key else True).cast("boolean")).withColumn("text", F.concat("value", F.lit("}")))
    if key:
        # A new list begins where the depth was, or falls, below that of records; up to its first brace it has to be the key's.
        opening = rf'(?s)^.*?"{key}"\s*+:\s*+\[[^{{}}\[\]"]*+\{{'
        head = F.regexp_extract("value", opening, 0)
        net = F.when(F.col("inside") == 0, _balance(_bare(head), False)).otherwise(_balance(_bare(head), True))
        own = (F.length(head) > 0) & (F.col("before") + net == F.col("level") + 1)
        begins = (F.col("after") >= F.col("level")) & ((F.col("before") < F.col("level")) | ((F.col("before") == F.col("level")) & (F.col("inside") == 0) & F.col("value").rlike(r'^[^"{\[]*\]')))
        p = p.withColumn("own", own).withColumn("begins", begins)
        p = p.withColumn("text", F.when(F.col("begins") & F.col("own"), F.col("text").substr(F.length(head), F.length("text"))).otherwise(F.col("text")))
        p = p.withColumn("section", F.last(F.when(F.col("begins"), F.col("own")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Pieces of one record in one range; the window's partitions serve this too.
    kept = F.when(F.col("after") >= F.col("level"), F.struct("pos", "text"))
    parts = p.groupBy("file", "block", "record").agg(F.collect_list(kept).alias("parts"), F.max("closes").alias("closes"), F.max_by("section", "pos").alias("section"))
    parts = materialize(parts.select("file", "block", F.col("record").cast("long").alias("record"), _text("parts").alias("text"), "closes", "section"), "json-parts")
    # What a range knows of the ones before: how many of them ended a record, and the list that was open last.
    known = parts.groupBy("file", "block").agg(F.max("closes").alias("ended"), F.max_by("section", F.when(F.col("section").isNotNull(), F.col("record"))).alias("open"))
    order = _earlier("file", order="block")
    known = materialize(known.select("file", "block", _sum("ended", order).alias("chain"), F.last("open", True).over(order).alias("open")), "json-known")
    parts = parts.join(small(known), ["file", "block"]).withColumn("section", F.coalesce("section", "open"))
    crossing = (F.col("record") == 0) | (F.col("closes") == 0)
    whole = parts.where(~crossing).select("section", "text")
    edges = parts.where(crossing).withColumn("chain", F.col("chain") + F.when((F.col("record") > 0), 1).otherwise(0))
    edges = edges.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "record", "text"))).alias("parts"), F.max("closes").alias("closes"), F.max_by("section", F.struct("block", "record")).alias("section"))
    edges = edges.where("closes = 1").select("section", _text("parts").alias("text"))
    return whole.union(edges).where("section").select(F.regexp_replace("text", AHEAD, "").alias("value"))


def parsed(texts: DataFrame, schema: str) -> DataFrame:
    """The objects of JSON texts (`value`), each an object or a list of them; texts that are no JSON are left out."""
    return texts.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r")).where("r is not null").select("r.*")


def read_records(spark: SparkSession, path: str, schema: str, key: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Records of `record_texts` with the columns of `schema`. Those that are no JSON are left out."""
    return parsed(record_texts(spark, path, key, encoding), schema)


def is_whole(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether JSON files hold one document each, over many lines; else each line is one. The first line that is read tells:
    it is a whole object only where lines are documents."""
    head = spark.read.option("lineSep", "}").text(path).where(F.col("value").rlike(r"\S")).first()  # a list's only line may be the whole file
    if head is not None and head[0].lstrip("\ufeff \t\r\n").startswith("["):
        return True
    first = spark.read.option("encoding", encoding).text(path).where("trim(value) <> ''").first()
    try:
        return first is not None and not isinstance(json.loads(first[0]), dict)
    except ValueError:
        return first[0].strip() in ("{", "[") or first[0].lstrip().startswith("[")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON files: one a line, or one file with an object or a list of objects, indented or not. A folder holds files
    of one kind. Lines and records that are no JSON are left out, and whole files whose brackets do not match."""
    if is_whole(spark, path):
        return read_records(spark, path, schema)
    return parsed(spark.read.text(path), schema)


def transcode(spark: SparkSession, source: str, target: str, schema: str, key: str | None = None) -> DataFrame:
    """Read JSON written in Latin-1, lines or whole files, write its records in UTF-8 lines, and read these. `key` names the list of
    whole files in which the records stand (see `record_texts`)."""
    if key or is_whole(spark, source, "ISO-8859-1"):
        read_records(spark, source, schema, key, "ISO-8859-1").write.json(target)
    else:
        spark.read.schema(schema).option("encoding", "ISO-8859-1").option("lineSep", "\n").json(source).write.json(target)
    return spark.read.schema(schema).json(target)


def read_pages(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records of paged dumps `{total_count, results: [...]}`, one page a file or a line. A page in one line is read by many tasks
    too, so a broken line leaves out its file."""
    return read_records(spark, path, record, "results")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """name and value of each price of fuel stations `{prix: [{@nom, @valeur}]}`."""
    df = read_documents(spark, path, "station: bigint, prix: array<struct<`@nom`: string, `@valeur`: string>>")
    return df.select("station", F.explode("prix").alias("p")).select("station", F.col("p.`@nom`").alias("name"), F.col("p.`@valeur`").alias("raw"))
