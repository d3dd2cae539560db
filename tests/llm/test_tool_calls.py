import json

from cohortlab.llm import tool_calls as c

CALLS = "conv_id string, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id string, call_id string, turn long, content string"
SCHEMAS = {"f": {"a": ("string", True), "b": ("object", False), "n": ("number", False)}}


def run(spark, calls, results):
    out = c.format_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS),
                         c.schema_table(spark, SCHEMAS))
    return {(r["conv_id"], r["call_id"], r["turn"]): r for r in out.collect()}


def test_linking_order_validation_and_json(spark):
    calls = [("c", "a", 0, "f", '{"b":{"z":1,"y":[1,2]},"a":"x"}', []), ("c", "b", 1, "f", '{"a":1}', ["a"]),
             ("c", "d", 2, "f", '{"a":"q","q":1}', ["a", "b"]), ("c", "e", 3, "g", None, ["d"]),
             ("c", "x", 4, "f", "nope", ["y"]), ("c", "y", 5, "f", '{"a":"k"}', ["x"]), ("c", "z", 6, "f", '{"n":"k"}', ["y", "a"]),
             ("c", "a", 7, "f", '{"a":"dup"}', []), ("c", None, 8, "f", "{}", None), ("c", "h", 9, "f", '{"a":"","n":1.5}', ["e", "nope"]),
             ("o", "a", 0, "f", '{"a":"other"}', None)]
    got = run(spark, calls, [("c", "a", 3, "later"), ("c", "a", 1, "ok"), ("c", "lost", 2, "?"), ("o", "b", 2, None)])
    by = {k[1:]: r for k, r in got.items() if k[0] == "c"}
    assert by["a", 0]["status"] == "linked" and by["a", 0]["result_turn"] == 1 and by["a", 7]["status"] == "duplicate"
    assert by[None, 8]["status"] == "unlinked" and by["lost", None]["status"] == "orphan"
    assert [by[k, t]["level"] for k, t in (("a", 0), ("b", 1), ("d", 2), ("e", 3), ("h", 9), ("x", 4), ("y", 5), ("z", 6))] == [
        0, 1, 2, 3, 4, None, None, None]
    assert [by[k, t]["errors"] for k, t in (("a", 0), ("b", 1), ("d", 2), ("e", 3), ("x", 4), ("z", 6), ("h", 9))] == [
        [], ["type:a"], ["unknown:q"], ["schema"], ["arguments"], ["missing:a", "type:n"], []]
    assert by["a", 0]["json"] == ('{"arguments":{"a":"x","b":{"y":[1,2],"z":1}},"depends_on":[],"errors":[],"id":"a",'
                                  '"level":0,"name":"f","result":"ok","status":"linked"}')
    assert by["a", None]["status"] == "repeated_result" and by["a", None]["result_turn"] == 3
    assert len(got) == len(calls) + 3


def test_no_result_and_no_role_is_lost(spark):
    got = run(spark, [("c", "a", 0, "f", '{"a":"x"}', [])], [
        ("c", "a", 1, "x"), ("c", "a", 2, "y"), ("c", "a", 1, "x"), (None, "a", 3, "z"), ("c", None, 4, None), ("c", "q", 5, "o"), ("c", "q", 6, "p")])
    assert len(got) == 1 + 3 + 1  # keyed by (conv, call, turn): repeated a, unlinked two, orphan and repeated q under one key
    out = c.format_calls(spark.createDataFrame([("c", "a", 0, "f", '{"a":"x"}', [])], CALLS), spark.createDataFrame(
        [("c", "a", 1, "x"), ("c", "a", 2, "y"), (None, "a", 3, "z"), ("c", "q", 5, "o"), ("c", "q", 6, "p")], RESULTS), c.schema_table(spark, SCHEMAS))
    assert sorted(r["status"] for r in out.collect()) == ["linked", "orphan", "repeated_result", "repeated_result", "unlinked_result"]
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "tool", "t"), (1, 2, None, "n"), (1, 3, "User", "u"), (1, None, "assistant", "x")],
                                  "conv_id long, turn long, role string, text string")
    st = sorted(r["status"] for r in c.format_calls(*c.conversation_calls(turns), c.schema_table(spark, c.CONVERSATION_SCHEMAS)).collect())
    assert st == ["other_role", "other_role", "other_role", "pending", "unlinked_result"]


def brute_levels(deps):
    """Longest chain before each call, by repeated relaxation; None in or behind a cycle."""
    level = {}
    for _ in deps:
        for k, d in deps.items():
            known = [x for x in d if x in deps]
            if k not in level and all(x in level for x in known):
                level[k] = 1 + max((level[x] for x in known), default=-1)
    return {k: level.get(k) for k in deps}


def test_levels_equal_brute_force_on_random_graphs(spark):
    import random
    r = random.Random(4)
    calls, want = [], {}
    for g in range(12):
        n = r.randint(2, 25)
        deps = {str(i): [str(r.randint(max(0, i - 6), max(0, i - 1)) + (r.random() < 0.02) * 3) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] for i in range(n)}
        calls += [(f"g{g}", k, int(k), "f", '{"a":"x"}', d) for k, d in deps.items()]
        want |= {(f"g{g}", k): v for k, v in brute_levels(deps).items()}
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in run(spark, calls, []).values()}
    assert got == want and None in want.values() and max(v or 0 for v in want.values()) > 4


def test_joins_are_hash_joins(spark):
    calls = spark.createDataFrame([("c", "a", 0, "f", "{}", [])], CALLS)
    plan = c.link(calls, spark.createDataFrame([("c", "a", 1, "x")], RESULTS))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_long_chain_takes_few_rounds(spark):
    n = 600
    calls = [("c", str(i), i, "f", '{"a":"x"}', [str(i - 1)]) for i in range(n)] + [("c", "j", n, "f", None, ["5", "599"])]
    got = run(spark, calls, [])
    assert [got["c", str(i), i]["level"] for i in range(n)] == list(range(n)) and got["c", "j", n]["level"] == n


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'say "hi"'), (1, 2, "assistant", "hi"), (1, 3, "user", None), (2, 0, "user", "é"),
            (2, 1, "assistant", "e"), (2, 1, "assistant", "e"), (3, 5, "assistant", "lost"), (None, 0, "user", "x"), (4, None, "user", "y"),
            (5, 0, None, "z"), (2, 0, "user", "é")]
    t = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, level int")
    out = c.format_calls(*c.conversation_calls(t), c.schema_table(spark, c.CONVERSATION_SCHEMAS)).collect()
    by = {(r["conv_id"], r["turn"]): r for r in out}
    assert by[1, 1]["status"] == "linked" and by[1, 1]["level"] == 1 and by[1, 3]["level"] == 2 and by[1, 3]["status"] == "pending"
    assert json.loads(by[1, 1]["json"])["arguments"] == {"n_chars": 8, "text": 'say "hi"'}
    assert not by[1, 3]["valid"] and by[2, 0]["valid"]
    assert sum(r["conv_id"] == 2 for r in out) == 2 and by[3, None]["status"] == "orphan"
    assert by[None, 0]["status"] == by[4, None]["status"] == "unlinked"
    empty = t.limit(0)
    assert c.format_calls(*c.conversation_calls(empty), c.schema_table(spark, c.CONVERSATION_SCHEMAS)).count() == 0
