import random

from autolot.llm import tools as T

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, content string"
RESULTS = "conv_id long, turn long, call_id string, content string"
GOOD = '{"query": "b", "limit": 3}'


def rows(spark, calls, results, schemas=T.SCHEMAS):
    return T.link(spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()


def test_links_orders_and_marks(spark):
    calls = [
        (1, 5, "late", "search", GOOD, None), (1, 1, "first", "search", GOOD, ["late", "missing"]), (1, 2, "dup", "note", '{"query": "1"}', []), (1, 3, "dup", "note", '{"query": "2"}', []), (1, 6, "c1", "search", GOOD, ["c2"]), (1, 7, "c2", "search", GOOD, ["c1"]),
        (2, 0, "first", "nope", GOOD, None), (2, 1, "bad", "search", "{", None), (3, 0, None, "search", GOOD, None), (3, 0, None, "search", GOOD, None),
    ]
    results = [(1, 9, "late", "b"), (1, 8, "late", "a"), (1, 8, "ghost", "z"), (2, 3, "first", None), (3, 1, None, "q")]
    got = rows(spark, calls, results)
    by = {(r.conv_id, r.call_id, r.status): r for r in got}
    assert len(got) == len(calls) + 2
    assert by[1, "late", "linked"].result_turn == 8 and by[1, "late", "linked"].n_results == 2
    assert by[1, "late", "linked"].position < by[1, "first", "unanswered"].position
    assert by[1, "dup", "duplicate"].position is None and by[1, "c1", "unanswered"].position is None and by[1, "c2", "unanswered"].position is None
    assert by[1, "ghost", "orphan"].result_turn == 8 and by[3, None, "orphan"].result_turn == 1
    assert by[2, "first", "linked"].errors == "$:tool" and by[2, "bad", "unanswered"].errors == "$:json" and by[2, "bad", "unanswered"].record is None
    assert by[1, "late", "linked"].record == '{"arguments":{"limit":3,"query":"b"},"id":"late","name":"search","result":"a"}'


def test_schemas():
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "integer", "minimum": 0}}, "b": {"enum": ["x", None]}, "c": {"type": "number"}, "d": {"type": "boolean"}}}
    assert T.errors_of({"a": [1, 2.0], "b": None, "c": 1, "d": True}, s) == []
    assert T.errors_of({"a": [-1, "x", True], "b": 3, "c": "1", "d": 0}, s) == ["$.a[0]:minimum", "$.a[1]:type", "$.a[2]:type", "$.b:enum", "$.c:type", "$.d:type"]
    assert T.errors_of([], s) == ["$:type"] and T.errors_of({}, s) == ["$.a:required"]


def test_deep_chains_and_empty_tables(spark):
    calls = [(1, 40 - i, f"c{i}", "search", GOOD, [f"c{i - 1}"] if i else []) for i in range(12)]
    got = {r.call_id: r.position for r in rows(spark, calls, [])}
    assert [got[f"c{i}"] for i in range(12)] == list(range(12))
    assert rows(spark, [], []) == []


def plain_order(calls):
    """Positions by repeated passes over plain dictionaries."""
    after = {c[2]: {x for x in c[5] or [] if x in {d[2] for d in calls}} for c in calls}
    turn, level = {c[2]: c[1] for c in calls}, {}
    while fresh := {c: 1 + max((level[x] for x in after[c]), default=-1) for c in after if c not in level and after[c] <= set(level)}:
        level |= fresh
    tangled = any(turn[c] is None or turn[x] is None or turn[x] >= turn[c] for c in after for x in after[c])
    order = sorted(level, key=lambda c: (level[c] if tangled else 0, turn[c] is not None, turn[c] or 0, c))
    return {c: k for k, c in enumerate(order)}


def test_random_orders_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(11)
    calls = []
    for conv in range(12):
        n = rng.randint(1, 30)
        for k in range(n):
            after = [f"c{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 1, 2]))] if conv % 3 else [f"c{x}" for x in range(k) if rng.random() < 0.2]
            calls.append((conv, rng.choice([None, k, 3]) if conv % 4 == 1 else k, f"c{k}", "search", GOOD, after))
    want = {(conv, c): p for conv in range(12) for c, p in plain_order([x for x in calls if x[0] == conv]).items()}
    for most in (T.LOCAL_EDGES, 10):
        monkeypatch.setattr(T.levels, "__defaults__", (most,))
        assert {(r.conv_id, r.call_id): r.position for r in rows(spark, calls, []) if r.position is not None} == want


def test_long_chains_need_no_rounds(spark):
    calls = [(1, 10_000 - k, f"c{k:05}", "search", GOOD, [f"c{k - 1:05}"] if k else []) for k in range(10_000)]
    got = {r.call_id: r.position for r in rows(spark, calls, [])}
    assert all(got[f"c{k:05}"] == k for k in range(10_000))


def test_chains_of_large_conversations_take_few_rounds(spark, monkeypatch):
    n = 700
    calls = [(1, n - k, f"c{k:03}", "search", GOOD, [f"c{k - 1:03}"] if k else []) for k in range(n)]
    calls += [(1, 1, "join", "search", GOOD, ["c699", "c350"]), (1, 0, "last", "search", GOOD, ["join"])]
    calls += [(1, 5, "a", "search", GOOD, ["b"]), (1, 5, "b", "search", GOOD, ["a"]), (1, 5, "behind", "search", GOOD, ["a", "c001"]), (1, 5, "self", "search", GOOD, ["self"])]
    monkeypatch.setattr(T.levels, "__defaults__", (10,))
    written, plain = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: written.append(name) or plain(df, name))
    got = {r.call_id: r.position for r in rows(spark, calls, [])}
    assert got == plain_order(calls) | dict.fromkeys(("a", "b", "behind", "self"))
    assert written.count("jumps") <= 12 and written.count("levels") <= 3


def test_nulls_and_clashing_names(spark):
    calls = [(1, None, "b", "search", GOOD, None), (1, None, "a", "search", GOOD, ["b"]), (1, 1, "c", "search", GOOD, []), (None, 1, "d", "search", GOOD, None), (1, 2, None, "search", GOOD, ["c"]), (1, 3, "long", "note", '{"query": "' + "x" * 3_000_000 + '"}', None)]
    extra = spark.createDataFrame([(*c, "x", 1, 2, 3, 4, "y") for c in calls], CALLS + ", level int, part int, position int, nth int, status string")
    got = {(r.conv_id, r.call_id): r for r in T.link(extra, spark.createDataFrame([], RESULTS), T.SCHEMAS).collect()}
    assert len(got) == 6 and {k: r.position for k, r in got.items()} == {(1, "b"): 0, (1, "c"): 1, (1, "long"): 2, (1, "a"): 3, (None, "d"): None, (1, None): None}
    assert got[1, "long"].errors == "$.query:maxLength" and len(got[1, "long"].record) > 3_000_000
