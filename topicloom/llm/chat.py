"""Chat formatting: tool calls linked to their results, in order, checked and written as canonical JSON (operator 9).

Messages have ``conv_id, turn, role, content, tool_calls, tool_call_id``: ``tool_calls`` is a JSON array of {id, name, arguments}, ``tool_call_id`` marks a
result.  Calls and results meet in a hash join on (conversation, identifier).  A call may name one other call it builds on, in the argument ``after``; depth and
the latest turn along such a chain come from pointer doubling, so a chain of length n takes log2(n) joins.  Arguments are checked against a table of tools
(field, type, required).  Every message, call and result is one row of JSON with sorted keys and no white space; sorting a conversation by ``order_turn, order_level, order_kind, turn``
puts each call before its result and behind the results it builds on.  Rows stay rows: a conversation of any length is never gathered.

Status: ``linked``, ``unanswered`` (no result), ``orphan`` (result without a call), ``duplicate`` (identifier used before in the conversation), ``cycle`` (calls that build on each
other in a circle); ``message`` for the rest.

Defined cases: null, empty or unreadable ``tool_calls`` hold no calls, and such a message is a row of its own; a call without an identifier or conversation is ``unanswered``; a null content is left out of the JSON; a reference to an unknown call is
listed as an error and counts as none; of several calls or results with one identifier the earliest turn is linked, repeated rows are duplicates of each other (one of them is linked); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import materialise

TYPES = {"integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "string": ["STRING"], "boolean": ["BOOLEAN"],
         "array": ["ARRAY"], "object": ["OBJECT"]}


def read_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, tool, args, after, nth): one row per call."""
    parsed = messages.where("tool_calls IS NOT NULL").selectExpr("conv_id", "turn", "try_variant_get(try_parse_json(tool_calls), '$', 'array<variant>') AS calls")
    single = parsed.selectExpr("conv_id", "turn", "posexplode(calls) AS (nth, call)")
    return single.selectExpr(
        "conv_id", "turn", "nth", "try_variant_get(call, '$.id', 'string') AS call_id", "try_variant_get(call, '$.name', 'string') AS tool",
        "to_json(try_variant_get(call, '$.arguments', 'variant')) AS args", "try_variant_get(call, '$.arguments.after', 'string') AS after")


def _first(rows: DataFrame, what: list[str]) -> DataFrame:
    """The earliest row of each identifier; combined in the map tasks."""
    known = rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    return known.groupBy("conv_id", "call_id").agg(F.min(F.struct(*what)).alias("first"))


def chains(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, reach, cycle) of distinct calls (conv_id, call_id, after, turn, result_turn).

    ``level`` counts the calls it builds on, ``reach`` is the latest turn of those calls and their results.  Each round doubles the distance looked back.
    """
    done_turn = F.greatest("turn", "result_turn")
    keys = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"), done_turn.alias("after_turn"))
    state = calls.join(keys, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("back"), F.when(F.col("known"), 1).otherwise(0).alias("level"),
        F.when(F.col("known"), F.col("after_turn")).alias("reach"))
    state, left = materialise(state, "chains"), None
    while True:
        waiting = state.where("back IS NOT NULL").count()
        if waiting == 0 or waiting == left:
            break
        # a node whose pointer has reached the end of its chain takes part no more
        step = state.select("conv_id", F.col("call_id").alias("back"), F.col("back").alias("next"), F.col("level").alias("more"), F.col("reach").alias("far"))
        state = materialise(state.join(step, ["conv_id", "back"], "left").select(
            "conv_id", "call_id", F.col("next").alias("back"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"),
            F.greatest("reach", "far").alias("reach")), "chains")
        left = waiting
    return state.select("conv_id", "call_id", "level", "reach", F.col("back").isNotNull().alias("cycle"))


def argument_errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds ``errors``, an array of texts; ``tools`` is (tool, field, type, required), a few fields for each tool."""
    fields = tools.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))
    kinds = F.expr("transform_values(from_json(args, 'map<string,variant>'), (k, v) -> regexp_extract(schema_of_variant(v), '^[A-Z]+', 0))")
    checked = calls.join(fields, "tool", "left").withColumn("kinds", F.coalesce(kinds, F.expr("map()").cast("map<string,string>")))
    allowed = F.create_map(*[x for t, k in TYPES.items() for x in (F.lit(t), F.array(*[F.lit(y) for y in k]))])
    present = lambda f: F.array_contains(F.map_keys("kinds"), f["field"])
    missing = F.transform(F.filter("fields", lambda f: f["required"] & ~present(f)), lambda f: F.concat(F.lit("missing:"), f["field"]))
    wrong = F.transform(
        F.filter("fields", lambda f: present(f) & ~F.coalesce(F.array_contains(allowed[f["type"]], F.col("kinds")[f["field"]]), F.lit(False))),
        lambda f: F.concat(F.lit("type:"), f["field"]))
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys("kinds"), F.transform("fields", lambda f: f["field"]))), lambda k: F.concat(F.lit("unknown:"), k))
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.concat(missing, wrong, unknown))
    return checked.withColumn("errors", errors).drop("fields", "kinds")


def format_chats(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, call_id, tool, status, errors, order_turn, order_level, order_kind, json): one row per message, call and result."""
    calls = materialise(read_calls(messages).withColumn("row", F.monotonically_increasing_id()), "calls")
    results = messages.where("tool_call_id IS NOT NULL").select("conv_id", "turn", F.col("tool_call_id").alias("call_id"), "content")
    results = materialise(results.withColumn("row", F.monotonically_increasing_id()), "results")
    first_calls = _first(calls, ["turn", "nth", "row", "after"])
    first_results = _first(results, ["turn", "row"])
    linked = first_calls.withColumnRenamed("first", "c").join(first_results.withColumnRenamed("first", "r"), ["conv_id", "call_id"], "left")
    owners = materialise(linked.select(
        "conv_id", "call_id", F.col("c.turn").alias("turn"), F.col("c.after").alias("after"), F.col("c.row").alias("call_row"),
        F.col("r.row").alias("result_row"), F.col("r.turn").alias("result_turn")), "owners")
    depth = chains(owners)
    placed = materialise(owners.join(depth, ["conv_id", "call_id"]).select(
        "conv_id", "call_id", "call_row", "result_row", "level", "cycle", F.greatest("turn", "reach").alias("call_turn"), "after"), "placed")

    facts = placed.select("conv_id", "call_id", "call_row", "result_row", "level", "cycle", "call_turn")
    reference = placed.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("after_known"))
    c = argument_errors(calls, tools).join(facts, ["conv_id", "call_id"], "left").join(reference, ["conv_id", "after"], "left")
    owner = F.coalesce(F.col("row") == F.col("call_row"), F.lit(False))
    status = (
        F.when(F.col("call_row").isNull(), "unanswered").when(~owner, "duplicate").when(F.col("cycle"), "cycle")
        .when(F.col("result_row").isNull(), "unanswered").otherwise("linked")
    )
    bad_reference = F.col("after").isNotNull() & F.col("after_known").isNull()
    call_rows = c.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", "tool", status.alias("status"),
        F.array_join(F.concat("errors", F.when(bad_reference, F.array(F.lit("reference:after"))).otherwise(F.array().cast("array<string>"))), ",").alias("errors"),
        F.when(owner & ~F.col("cycle"), F.col("call_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(owner & ~F.col("cycle"), F.col("level")).otherwise(0).alias("order_level"), F.lit(0).alias("order_kind"),
        F.to_json(F.struct(F.try_parse_json("args").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"))).alias("json"))
    r = results.join(facts, ["conv_id", "call_id"], "left")
    answers = F.coalesce(F.col("row") == F.col("result_row"), F.lit(False))
    result_rows = r.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("tool"),
        F.when(F.col("call_row").isNull(), "orphan").when(~answers, "duplicate").when(F.col("cycle"), "cycle").otherwise("linked").alias("status"),
        F.lit("").alias("errors"), F.when(answers & ~F.col("cycle"), F.greatest("turn", "call_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(answers & ~F.col("cycle"), F.col("level")).otherwise(0).alias("order_level"), F.lit(1).alias("order_kind"),
        F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("tool").alias("role"))).alias("json"))
    # a message that holds no readable call is a row of its own, whatever else it lacks
    held = "coalesce(size(try_variant_get(try_parse_json(tool_calls), '$', 'array<variant>')), 0)"
    plain = messages.where(f"tool_call_id IS NULL AND (content IS NOT NULL OR {held} <= 0)").select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("tool"),
        F.lit("message").alias("status"), F.lit("").alias("errors"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"),
        F.lit(0).alias("order_kind"), F.to_json(F.struct("content", "role")).alias("json"))
    return plain.union(call_rows).union(result_rows)
