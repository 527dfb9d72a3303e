"""Tool calls of conversations: link calls with results, order them, validate and serialise them.

Calls and results are hash-joined by conversation and identifier. Calls are ordered topologically, after
all calls they name as coming before (see `levels`). Arguments are checked against the tools' schemas (the JSON Schema keywords of `errors_of`), and a record is written
as canonical JSON: sorted keys, no blanks, no escapes that are not needed.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autolot.llm.common import materialize, shared_dir, table, typed
from autolot.llm.graphs import maybe_broadcast

#: Edges and calls of a conversation that one task orders.
LOCAL_EDGES = 200_000
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "required": ["limit", "query"], "additionalProperties": False, "properties": {"limit": {"type": "integer", "minimum": 1, "maximum": 50}, "query": {"type": "string", "minLength": 1}}},
    "lookup": {"type": "object", "required": ["limit", "query"], "additionalProperties": False, "properties": {"limit": {"type": "integer", "minimum": 1, "maximum": 100}, "query": {"type": "string", "minLength": 1}}},
    "note": {"type": "object", "required": ["query"], "properties": {"limit": {"type": "integer"}, "query": {"type": "string", "maxLength": 600}}},
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, _KINDS[kind])


def errors_of(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What breaks the schema, as `path:keyword`: type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength."""
    if "type" in schema and not _is(value, schema["type"]):
        return [f"{at}:type"]
    out = [f"{at}:enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}:required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += errors_of(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}:additionalProperties")
    elif isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += errors_of(x, schema["items"], f"{at}[{k}]")
    elif isinstance(value, str):
        out += [f"{at}:minLength"] * (len(value) < schema.get("minLength", 0)) + [f"{at}:maxLength"] * (len(value) > schema.get("maxLength", math.inf))
    elif isinstance(value, int | float) and not isinstance(value, bool):
        out += [f"{at}:minimum"] * (value < schema.get("minimum", -math.inf)) + [f"{at}:maximum"] * (value > schema.get("maximum", math.inf))
    return out


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(name)


def checked(schemas: dict[str, dict]):
    """A column function of name, call_id, arguments and result: valid, errors (comma-joined), record."""

    def one(name, call_id, arguments, result) -> tuple[bool, str, str | None]:
        try:
            value = json.loads(arguments, parse_constant=_no_constant)
            errors = errors_of(value, schemas[name]) if name in schemas else ["$:tool"]
            return not errors, ",".join(errors), canonical({"arguments": value, "id": call_id, "name": name, "result": result})
        except (ValueError, TypeError, RecursionError, OverflowError):
            return False, "$:json", None

    @F.pandas_udf("valid boolean, errors string, record string")
    def run(name: pd.Series, call_id: pd.Series, arguments: pd.Series, result: pd.Series) -> pd.DataFrame:
        rows = zip(*(s.astype(object).where(s.notna(), None) for s in (name, call_id, arguments, result)), strict=True)
        return pd.DataFrame([one(*r) for r in rows], columns=["valid", "errors", "record"])

    return run


def _local_levels(frame: pd.DataFrame) -> pd.DataFrame:
    """Levels of one conversation's calls by Kahn's algorithm; `frame` has a row for each edge, or call without one (before is null)."""
    waits: Counter = Counter()
    after: dict[str, list[str]] = {}
    for call, before in zip(frame["call_id"], frame["before"], strict=True):
        waits[call] += 0
        if before is not None:
            waits[call] += 1
            after.setdefault(before, []).append(call)
    level = dict.fromkeys((c for c, n in waits.items() if not n), 0)
    ready = list(level)
    for call in ready:
        for other in after.get(call, ()):
            waits[other] -= 1
            if not waits[other]:  # the last one before it is settled, and none of them is higher: calls settle by level
                level[other] = level[call] + 1
                ready.append(other)
    return pd.DataFrame({"conv_id": frame["conv_id"].iloc[0], "call_id": list(level), "level": list(level.values())})


def levels(calls: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """(conv_id, call_id, level) of different calls (conv_id, call_id, turn, after).

    Where all calls of a conversation come after calls of earlier turns only, as in an orderly log, turns are
    a topological order already, and the level is 0. In other conversations it is one more than the highest level of the
    calls before it; null on and behind a cycle. Conversations of at most `most` edges and calls are ordered in one task
    each. In larger ones chains of calls that wait for one other are contracted, in rounds that go with the logarithm of their
    length; of calls that wait for several, a round settles those whose predecessors are settled, so there are as many more rounds as
    such calls follow one another. Calls named in `after` that do not exist don't count.
    """
    calls = materialize(calls.select("conv_id", "call_id", "turn", "after"), "calls")
    ids = calls.select("conv_id", F.col("call_id").alias("before"), F.col("turn").alias("before_turn"))
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("before")).join(ids.hint("shuffle_hash"), ["conv_id", "before"])
    tangled = materialize(edges.where("before_turn >= turn or turn is null or before_turn is null").select("conv_id").distinct(), "tangled")
    if tangled.isEmpty():
        return calls.select("conv_id", "call_id", F.lit(0).alias("level"))
    edges = materialize(edges.select("conv_id", "call_id", "before").join(maybe_broadcast(tangled), "conv_id", "left_semi"), "edges")
    free = calls.join(maybe_broadcast(tangled), "conv_id", "left_semi").join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    rows = materialize(edges.unionByName(free.select("conv_id", "call_id", F.lit(None).cast("string").alias("before"))), "order")
    size = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    large = size.where(F.col("n") > most).select("conv_id")
    kind = typed(calls.schema["conv_id"].dataType)
    local = rows.join(large, "conv_id", "left_anti").groupBy("conv_id").applyInPandas(_local_levels, f"conv_id {kind}, call_id string, level int")
    found = local if large.isEmpty() else local.unionByName(_settled(rows.join(large, "conv_id", "left_semi")))
    ordered = calls.select("conv_id", "call_id").join(maybe_broadcast(tangled), "conv_id", "left_anti").withColumn("level", F.lit(0))
    return ordered.unionByName(found)


def _chained(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, to, far, done: for each call that waits for one other, how many steps before it (`far`) the first call `to` stands
    that waits for none or for several. `done` is false on and behind a cycle of such calls.

    Steps double from round to round, so a chain of n calls takes about log2(n) rounds.
    """
    one = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("before").alias("to")).where("n = 1")
    one = materialize(one.select("conv_id", "call_id", "to", F.lit(1).cast("long").alias("far")), "single")
    inner = one.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("inner"))
    jumps = materialize(one.join(inner, ["conv_id", "to"], "left").select("conv_id", "call_id", "to", "far", F.col("inner").isNull().alias("done")), "jumps")
    for _ in range(one.count().bit_length()):  # then a step is longer than any chain
        moving = jumps.where("not done")
        if moving.isEmpty():
            break
        further = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        moved = moving.drop("done").join(further, ["conv_id", "to"]).select("conv_id", "call_id", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_done").alias("done"))
        jumps = materialize(jumps.where("done").unionByName(moved), "jumps")
    return jumps


def _settled(rows: DataFrame) -> DataFrame:
    """Levels of the calls of large conversations. Chains of calls that wait for one other are contracted; of the rest a round settles
    the calls whose predecessors are settled, and appends them to one table; then chains follow the calls they hang on."""
    spark = rows.sparkSession
    start = rows.where("before is null").select("conv_id", "call_id", F.lit(0).alias("level"))
    edges = materialize(rows.where("before is not null").select("conv_id", "call_id", "before"), "left")
    jumps = _chained(edges)
    ends = jumps.where("done").select("conv_id", F.col("call_id").alias("before"), "to", "far")
    several = edges.join(jumps.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(ends, ["conv_id", "before"], "left")
    left = materialize(several.select("conv_id", "call_id", F.coalesce("to", "before").alias("before"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "left")
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    start.write.parquet(path)
    while not left.isEmpty():
        known = spark.read.schema(start.schema).parquet(path).select("conv_id", F.col("call_id").alias("before"), "level")
        state = left.join(known, ["conv_id", "before"], "left").groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("level").alias("m"), F.max(F.col("level") + F.col("far")).alias("top"))
        fresh = materialize(state.where("n = m").select("conv_id", "call_id", F.col("top").cast("int").alias("level")), "levels")
        if fresh.isEmpty():
            break
        fresh.write.mode("append").parquet(path)
        left = materialize(left.join(fresh.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "left")
    known = spark.read.schema(start.schema).parquet(path)
    chained = jumps.where("done").join(known.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"])
    return known.unionByName(chained.select("conv_id", "call_id", (F.col("level") + F.col("far")).cast("int").alias("level")))


def positions(rows: DataFrame) -> DataFrame:
    """Add `position`, from 0 in each conv_id, by level, turn (null first) and call_id; null where the level is null.

    Rows are dealt to ranges of this order and numbered within, and a range starts after the rows of those before it; so
    no conversation, and no turn of many calls, is sorted in one task.
    """
    order = [F.col("level"), F.col("turn").asc_nulls_first(), F.col("call_id")]
    known = rows.where("level is not null")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    known = known.repartitionByRange(ranges, F.col("conv_id").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id())
    known = materialize(known, "ranges")
    counts = known.groupBy("conv_id", "part").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    numbered = known.withColumn("k", inside).join(counts, F.expr("conv_id <=> _conv and part = _part"))
    numbered = numbered.withColumn("position", (F.col("start") + F.col("k") - 1).cast("long")).drop("_conv", "_part", "start", "part", "k")
    return numbered.unionByName(rows.where("level is null").withColumn("position", F.lit(None).cast("long")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call, and for each result without a call.

    `calls`: conv_id, turn, call_id, name, arguments (JSON), after (array of call_ids). `results`: conv_id, turn,
    call_id, content. Returns conv_id, call_id, turn, name, status, result_turn, n_results, position, valid,
    errors, record. status: `linked`; `unanswered`; `duplicate`, a call whose identifier an earlier turn of the
    conversation has (ties: the lesser arguments, then one row of equals); `orphan`, a result without a call.
    Of several results the earliest counts (ties: the lesser content). position numbers a conversation's calls
    in topological order from 0 (by level, turn, call_id; calls without a turn first of their level); it is null on and
    behind a cycle, for calls without conv_id or call_id, orphans and duplicates. Null identifiers link with nothing.
    Broken arguments are invalid and give no record. Very long arguments and contents are read whole; other columns,
    whatever they are called, are ignored; empty tables give no rows.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    first = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "arguments", "name"))
    calls = materialize(calls.withColumn("nth", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), 1).otherwise(first)), "calls")
    ids = calls.where("nth = 1 and conv_id is not null and call_id is not null")
    best = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    found = best.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"), "n_results")
    level = materialize(levels(ids), "level")
    linked = calls.where("nth = 1").join(found.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(level.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    linked = positions(materialize(linked, "linked"))
    linked = linked.withColumn("status", F.when(F.col("n_results").isNull(), "unanswered").otherwise("linked"))
    none = {"result_turn": "long", "result": "string", "n_results": "long", "position": "long"}
    again = calls.where("nth > 1").withColumn("status", F.lit("duplicate")).select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    columns = ["conv_id", "call_id", "turn", "name", "status", "arguments", *none]
    rows = linked.select(*columns).unionByName(again.select(*columns))
    checks = checked(schemas)(F.col("name"), F.col("call_id"), F.col("arguments"), F.col("result"))
    rows = rows.withColumn("c", checks).select("conv_id", "call_id", "turn", "name", "status", F.col("result_turn").cast("long"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("position").cast("long"), "c.valid", "c.errors", "c.record")
    orphans = results.join(ids.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    orphans = orphans.select("conv_id", "call_id", F.lit(None).cast(calls.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("status"), F.col("turn").cast("long").alias("result_turn"), F.lit(1).cast("long").alias("n_results"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("errors"), F.lit(None).cast("string").alias("record"))
    return rows.unionByName(orphans)


def lift(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations (conv_id, turn, role, text).

    A user's turn is a call, with the turn's text as query; it comes after the call two turns before, but in every fifth
    conversation, whose log runs backwards, after the call two turns later. An assistant's turn is the result of the call
    one turn before.
    """
    name = F.element_at(F.array(*map(F.lit, ("search", "lookup", "note"))), (F.col("turn") % 3 + 1).cast("int"))
    ident = lambda back: F.concat_ws("-", "conv_id", (F.col("turn") - back).cast("string"))
    limit = F.size(F.split("text", " "))
    calls = conversations.where("role = 'user'").select(
        "conv_id", "turn", ident(0).alias("call_id"), name.alias("name"), F.to_json(F.struct(F.col("text").alias("query"), limit.alias("limit"))).alias("arguments"), F.when(F.col("conv_id") % 5 == 0, F.array(ident(-2))).otherwise(F.array(ident(2))).alias("after")
    )
    return calls, conversations.where("role = 'assistant'").select("conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*lift(table(spark, sf_dir, "conversations")), SCHEMAS)


SQL = """
WITH c AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, ['search', 'lookup', 'note'][(turn % 3 + 1)::INT] AS name, text, len(string_split(text, ' ')) AS lim
  FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
i AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c),
o AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN count(*) OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn DESC) - 1 ELSE 0 END AS level FROM i),
x AS (SELECT o.*, r.turn AS rt, r.text AS res, row_number() OVER (PARTITION BY o.conv_id ORDER BY level, o.turn, call_id) - 1 AS position,
    concat_ws(',', CASE WHEN name = 'search' AND lim > 50 THEN '$.limit:maximum' WHEN name = 'lookup' AND lim > 100 THEN '$.limit:maximum' END,
                   CASE WHEN name <> 'note' AND o.text = '' THEN '$.query:minLength' WHEN name = 'note' AND length(o.text) > 600 THEN '$.query:maxLength' END) AS errors
  FROM o LEFT JOIN r USING (conv_id, call_id))
SELECT conv_id, call_id, turn, name, CASE WHEN rt IS NULL THEN 'unanswered' ELSE 'linked' END AS status, rt::BIGINT AS result_turn,
  CASE WHEN rt IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results, position::BIGINT AS position, errors = '' AS valid, errors,
  '{"arguments":{"limit":' || lim || ',"query":' || to_json(text)::VARCHAR || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(to_json(res)::VARCHAR, 'null') || '}' AS record FROM x
UNION ALL
SELECT conv_id, call_id, NULL, NULL, 'orphan', turn::BIGINT, 1::BIGINT, NULL, NULL, NULL, NULL FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
