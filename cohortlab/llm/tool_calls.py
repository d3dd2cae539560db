"""Tool-call linking for chat data (DataFrame functions only).

- Calls and results are hash-joined by conversation and call identifier.
- Calls are ordered topologically by what they depend on.  ``level`` is the longest
  chain of calls before one: chains of calls with a single dependency are contracted
  by pointer doubling, so a chain of any length takes logarithmically many joins, and
  calls with several dependencies follow round by round.  Calls in or behind a cycle
  have no level.
- Arguments are checked against a schema table (missing, unknown and mistyped fields).
- Each call is serialised as canonical JSON: keys sorted at every depth, no spaces.

Everything is joined on (conversation, identifier), so a long conversation or a
frequent tool is no group of its own; repeats of an identifier are reduced by partial
aggregates before any join.

Defined results: a call without an identifier or conversation is ``unlinked``; of
calls that share an identifier the first by turn counts and the others are
``duplicate`` (equal rows are the same call); of several results the first by turn
counts and the others are ``repeated_result`` (equal rows are the same result); a result
without a call is an ``orphan``, one without an identifier or conversation an
``unlinked_result``; a call that comes with a ``status`` keeps it and is not linked
(turns of other roles: ``other_role``); dependencies on unknown calls are ignored; arguments that are no JSON object are invalid (NULL: an empty object); a name
without a schema is invalid; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import stage

#: JSON types by what the argument holds
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID"}


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with ``status``, ``result`` and ``result_turn``, and results without a call.

    ``calls``: conv_id, call_id, turn, name, arguments, depends_on.
    ``results``: conv_id, call_id, turn, content.
    """
    key = ["conv_id", "call_id"]
    given = F.col("status") if "status" in calls.columns else F.lit(None).cast("string")
    c = stage(calls.select(*key, "turn", "name", "arguments", "depends_on", given.alias("given")), "chat-calls")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    order = F.struct("turn", F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")))
    firsts = stage(c.filter(named & F.col("given").isNull()).groupBy(*key).agg(F.min(order).alias("first"))
                   .select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_id"), "first"), "chat-first-calls")
    r = stage(results.select(*key, "turn", "content").distinct(), "chat-results")
    got = stage(r.filter(named).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"))
                .select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"),
                        F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"), F.lit(True).alias("has")),
                "chat-first-results")
    j = (c.withColumn("order", order)
         .join(_hashed(firsts), (F.col("conv_id") == F.col("f_conv")) & (F.col("call_id") == F.col("f_id")), "left")
         .join(_hashed(got), (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left"))
    own = F.col("order") == F.col("first")
    status = (F.when(F.col("given").isNotNull(), F.col("given")).when(F.col("f_id").isNull(), "unlinked").when(~own, "duplicate")
              .when(F.col("has"), "linked").otherwise("pending"))
    linked = F.col("status") == "linked"
    out = j.withColumn("status", status).select(
        *key, "turn", "name", "arguments", "depends_on", "status",
        F.when(linked, F.col("result_turn")).alias("result_turn"), F.when(linked, F.col("result")).alias("result"))
    # every result that is no call's own is a row too
    first = F.col("turn").eqNullSafe(F.col("result_turn")) & F.col("content").eqNullSafe(F.col("result"))
    rest = (r.join(_hashed(got), (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left")
            .join(_hashed(firsts), (F.col("conv_id") == F.col("f_conv")) & (F.col("call_id") == F.col("f_id")), "left"))
    lone = F.when(F.col("has").isNull(), "unlinked_result").when(~first, "repeated_result").when(F.col("f_id").isNull(), "orphan")
    rest = rest.withColumn("status", lone).filter(F.col("status").isNotNull()).select(
        *key, F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("depends_on"), "status",
        F.col("turn").alias("result_turn"), F.col("content").alias("result"))
    return out.unionByName(rest)


def _hashed(df: DataFrame) -> DataFrame:
    """The build side of a shuffle hash join: one row per key, so a task's table is a share of its keys."""
    return df.hint("shuffle_hash")


def levels(linked: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of the calls that count; no level behind a cycle."""
    key = ["conv_id", "call_id"]
    nodes = linked.filter(F.col("status").isin("linked", "pending")).select(*key, "depends_on").dropDuplicates(key)
    known = nodes.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"))
    edges = (nodes.select(*key, F.explode(F.array_distinct("depends_on")).alias("dep")).filter("dep IS NOT NULL")
             .join(_hashed(known), (F.col("conv_id") == F.col("k_conv")) & (F.col("dep") == F.col("k_id")), "left_semi"))
    edges = stage(edges, "chat-edges")
    degree = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    # a call points at its only dependency; roots and calls with several point at themselves
    ptr = nodes.select(*key).join(_hashed(degree), key, "left").select(
        *key, F.when(F.col("n") == 1, F.col("dep")).otherwise(F.col("call_id")).alias("ptr"),
        F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("dist"),
        F.coalesce("n", F.lit(0)).alias("n"))
    ptr = stage(ptr, "chat-pointers")
    ends = ptr.filter("n <> 1").select(F.col("conv_id").alias("e_conv"), F.col("call_id").alias("e_id"))
    size = ptr.count()
    for _ in range(max(1, size).bit_length() + 1):
        moving = ptr.join(_hashed(ends), (F.col("conv_id") == F.col("e_conv")) & (F.col("ptr") == F.col("e_id")), "left_anti")
        if moving.isEmpty():
            break
        step = ptr.select(F.col("conv_id").alias("s_conv"), F.col("call_id").alias("s_id"), F.col("ptr").alias("s_ptr"),
                          F.col("dist").alias("s_dist"))
        ptr = stage(ptr.join(_hashed(step), (F.col("conv_id") == F.col("s_conv")) & (F.col("ptr") == F.col("s_id")))
                    .select(*key, F.col("s_ptr").alias("ptr"), (F.col("dist") + F.col("s_dist")).alias("dist"), "n"),
                    "chat-pointers")
    settled = ptr.join(_hashed(ends), (F.col("conv_id") == F.col("e_conv")) & (F.col("ptr") == F.col("e_id")), "left_semi")
    base = ptr.filter("n = 0").select(F.col("conv_id").alias("b_conv"), F.col("call_id").alias("b_id"),
                                      F.lit(0).cast("long").alias("base"))
    joins = ptr.filter("n > 1").select(*key)
    if not joins.isEmpty():
        # dependencies of calls with several: the end of each one's chain and the way from there
        ways = stage(edges.join(_hashed(joins), key, "left_semi").join(
            _hashed(settled.select(F.col("conv_id").alias("w_conv"), F.col("call_id").alias("w_id"), "ptr", "dist")),
            (F.col("conv_id") == F.col("w_conv")) & (F.col("dep") == F.col("w_id")), "left")
            .select(*key, "ptr", "dist"), "chat-ways")
        base = stage(base, "chat-levels")
        while True:
            ready = (ways.join(_hashed(base.select("b_conv", "b_id")), (F.col("conv_id") == F.col("b_conv"))
                               & (F.col("call_id") == F.col("b_id")), "left_anti")
                     .join(_hashed(base), (F.col("conv_id") == F.col("b_conv")) & (F.col("ptr") == F.col("b_id")), "left")
                     .groupBy(*key).agg(F.max(F.col("base") + F.col("dist") + 1).alias("base"),
                                        F.count("*").alias("all"), F.count("base").alias("known"))
                     .filter(F.col("all") == F.col("known"))
                     .select(F.col("conv_id").alias("b_conv"), F.col("call_id").alias("b_id"), "base"))
            ready = stage(ready, "chat-ready")
            if ready.isEmpty():
                break
            base = stage(base.union(ready), "chat-levels")
    return settled.join(_hashed(base), (F.col("conv_id") == F.col("b_conv")) & (F.col("ptr") == F.col("b_id"))).select(
        F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_id"), (F.col("base") + F.col("dist")).alias("level"))


def schema_table(spark: SparkSession, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """``(tool, fields, required)`` from ``{tool: {field: (type, required)}}``."""
    rows = [(tool, {f: t for f, (t, _) in fields.items()}, sorted(f for f, (_, r) in fields.items() if r))
            for tool, fields in schemas.items()]
    return spark.createDataFrame(rows, "tool string, fields map<string,string>, required array<string>")


def validate(linked: DataFrame, schemas: DataFrame) -> DataFrame:
    """``linked`` with ``parsed`` (variant), ``errors`` (sorted) and ``valid``."""
    j = linked.join(schemas, F.col("name") == F.col("tool"), "left")
    v = F.try_parse_json(F.coalesce("arguments", F.lit("{}")))
    j = j.withColumn("parsed", v)
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    j = j.withColumn("args", F.when(is_object, F.col("parsed").cast("map<string,variant>")))

    def wrong(e):
        kind = F.schema_of_variant(e["value"])
        want = F.try_element_at(F.col("fields"), e["key"])
        ok = F.lit(False)
        for name, spark_type in _TYPES.items():
            ok = ok | ((want == name) & (kind == spark_type))
        ok = (ok | (want == "any") | ((want == "number") & kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"))
              | ((want == "array") & kind.startswith("ARRAY")) | ((want == "object") & kind.startswith("OBJECT")))
        return (F.when(want.isNull(), F.concat(F.lit("unknown:"), e["key"]))
                .when(~ok, F.concat(F.lit("type:"), e["key"])))

    found = F.filter(F.transform(F.map_entries("args"), wrong), lambda x: x.isNotNull())
    missing = F.transform(F.array_except("required", F.map_keys("args")), lambda k: F.concat(F.lit("missing:"), k))
    errors = (F.when(F.col("status").isin("orphan", "unlinked_result", "repeated_result", "other_role"), F.array(F.lit("call")))
              .when(F.col("tool").isNull(), F.array(F.lit("schema")))
              .when(F.col("args").isNull(), F.array(F.lit("arguments")))
              .otherwise(F.array_sort(F.concat(found, missing))))
    return (j.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
            .drop("tool", "fields", "required", "args"))


def canonical(checked: DataFrame) -> DataFrame:
    """``checked`` with ``json``; variants keep their keys sorted, the outer keys are in order here."""
    body = F.to_json(F.struct(
        F.col("parsed").alias("arguments"),
        F.array_sort(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("depends_on"),
        "errors", F.col("call_id").alias("id"), "level", "name", "result", "status"))
    return checked.withColumn("json", body)


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Linked, ordered, validated and serialised calls; sort by (conv_id, level, turn, call_id) for an order."""
    linked = stage(link(calls, results), "chat-linked")
    lv = stage(levels(linked), "chat-call-levels")
    j = linked.join(_hashed(lv), (F.col("conv_id") == F.col("l_conv")) & (F.col("call_id") == F.col("l_id"))
                    & F.col("status").isin("linked", "pending"), "left")
    return canonical(validate(j, schemas)).select(
        "conv_id", "call_id", "turn", "name", "status", "level", "result_turn", "valid", "errors", "json")


#: schemas of the calls that ``conversation_calls`` derives
CONVERSATION_SCHEMAS = {
    "reply": {"n_chars": ("integer", True), "text": ("string", True)},
    "configure": {"text": ("string", True)},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations ``(conv_id, turn, role, text)``.

    A user turn is a call of ``reply`` that depends on the exchange before it, a
    system turn is a call of ``configure`` without a result, and an assistant turn is
    the result of the call one turn before it.  Turns of any other role, or none, are
    calls of nothing with the status ``other_role``.
    """
    ident = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    t = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    known = F.when(F.col("turn").isNotNull(), ident(F.col("turn")))
    user = F.col("role") == "user"
    other = ~F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    calls = t.filter(~F.coalesce(F.col("role") == "assistant", F.lit(False))).select(
        "conv_id", known.alias("call_id"), "turn", F.when(other, None).when(user, "reply").otherwise("configure").alias("name"),
        F.when(user, F.to_json(F.struct("text", F.length("text").alias("n_chars")))).otherwise(
            F.to_json(F.struct("text"))).alias("arguments"),
        F.when(user, F.array(ident(F.col("turn") - 2), ident(F.col("turn") - 1))).otherwise(
            F.array().cast("array<string>")).alias("depends_on"), F.when(other, "other_role").alias("status"))
    results = t.filter(F.col("role") == "assistant").select(
        "conv_id", F.when(F.col("turn").isNotNull(), ident(F.col("turn") - 1)).alias("call_id"), "turn",
        F.col("text").alias("content"))
    return calls, results
