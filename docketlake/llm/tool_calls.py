"""Tool calls of chats: linking with results, topological order, argument checks and canonical JSON. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.base import checkpoint


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): length of the chain of parents above each call; null in or below a cycle.

    Each round doubles how far a call looks up (one join and a checkpoint), so a chain of n calls takes
    log2(n) rounds. A round that ends no chain is the last: of a longer chain, it would have ended the part
    of that length, so what is left stands in or below a cycle. A parent that does not exist counts as none.
    """
    ids = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("up"))
    known = calls.join(ids, (F.col("conv_id") == F.col("c")) & (F.col("parent_id") == F.col("up")), "left")
    state = checkpoint(known.select("conv_id", "call_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    left, before = state.where("up is not null").count(), -1
    while left and left != before:
        above = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("up").alias("next"), F.col("depth").alias("more"))
        open_ = state.where("up is not null").join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("i")))
        state = checkpoint(state.where("up is null").union(open_.select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))))
        left, before = state.where("up is not null").count(), left
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def argument_errors(arguments: F.Column, schema: dict[str, tuple[str, bool]]) -> F.Column:
    """Errors of parsed arguments (a variant) against property -> (type, required), in order of property; null for none.

    Types are those of JSON: string, integer, number, boolean, array, object.
    """
    names = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}
    found = [F.when(arguments.isNull(), "not an object").when(~F.schema_of_variant(arguments).rlike("^OBJECT<"), "not an object")]
    for name, (kind, required) in sorted(schema.items()):
        value = F.try_variant_get(arguments, f"$.{name}", "variant")
        missing = value.isNull() | F.is_variant_null(value)
        wrong = F.when(missing, F.lit(f"{name} is missing") if required else F.lit(None)).when(~F.schema_of_variant(value).rlike(names[kind]), f"{name} is not {kind}")
        found.append(F.when(arguments.isNotNull() & F.schema_of_variant(arguments).rlike("^OBJECT<"), wrong))
    joined = F.concat_ws("; ", *found)
    return F.when(joined != "", joined)


def positions(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, position): places of calls (conv_id, call_id, depth, turn) in topological order, from 0 in each conversation.

    All calls are sorted once over ranges, so a hot conversation is spread over as many tasks as it fills;
    a place is that in the range, plus what earlier ranges hold of the conversation.
    """
    order = ["conv_id", "depth", "turn", "call_id"]
    ranged = calls.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpoint(ranged.select("conv_id", "call_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    held = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # at most one row a range for a hot conversation
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(held, ["conv_id", "part"]).select("conv_id", "call_id", (F.col("at") + F.col("shift")).alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call: conv_id, call_id, turn, name, depth, position, status, errors, canonical.

    calls: conv_id, call_id, turn, name, arguments (JSON text), parent_id (a call that must come first,
    or null). results: conv_id, call_id, turn, content. position is the place of a call in the topological
    order of its conversation, which is that of (depth, turn, call_id); calls in or below a cycle have none. Several calls of one id are one: that of the least turn, name and
    arguments, with status `repeated`; of several results of one id the first counts. Other statuses:
    `cycle`, `early` (the result stands before the call), `unanswered`, `linked`. errors is null for valid
    arguments; a tool without a schema is an error. canonical is the call as JSON with keys in order, its
    arguments parsed and written again; where they are no JSON, they stand as null.

    Rows with a null conv_id or call_id cannot be linked and are left out. Ids are grouped before they
    are joined, so a hot conversation is spread over its ids. Extra columns are not read.
    """
    calls = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "parent_id")).alias("first"), F.count("*").alias("n")).select("conv_id", "call_id", "first.*", "n")
    calls = checkpoint(calls)
    results = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("result"))
    deep = checkpoint(calls.select("conv_id", "call_id", "turn").join(depths(calls), ["conv_id", "call_id"]))
    placed = deep.drop("turn").join(positions(deep.where("depth is not null")), ["conv_id", "call_id"], "left")
    linked = calls.join(placed, ["conv_id", "call_id"]).join(results, ["conv_id", "call_id"], "left")
    parsed = linked.withColumn("parsed", F.try_parse_json("arguments"))
    checked = F.lit("unknown tool")
    for name, schema in schemas.items():
        checked = F.when(F.col("name") == name, argument_errors(F.col("parsed"), schema)).otherwise(checked)
    status = F.when(F.col("depth").isNull(), "cycle").when(F.col("n") > 1, "repeated").when(F.col("result").isNull(), "unanswered").when(F.col("result.turn") < F.col("turn"), "early").otherwise("linked")
    out = parsed.select("conv_id", "call_id", "turn", "name", "depth", "position", status.alias("status"), checked.alias("errors"), "parsed", F.col("result.content").alias("content"))
    canonical = F.to_json(F.struct(F.col("parsed").alias("arguments"), "call_id", "conv_id", "depth", "errors", "name", "position", F.col("content").alias("result"), "status", "turn"), {"ignoreNullFields": "false"})
    return out.withColumn("canonical", canonical).drop("parsed", "content")


def logged_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text) whose text is JSON: of an assistant
    {"tool_calls": [{"id", "name", "arguments", "parent_id"}]}, of a tool {"tool_call_id", "content"}. Other texts give none."""
    body = F.from_json("text", "tool_calls array<struct<id string, name string, arguments variant, parent_id string>>, tool_call_id string, content string")
    said = messages.select("conv_id", "turn", "role", body.alias("m"))
    calls = said.where("role = 'assistant'").select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"), F.col("c.parent_id").alias("parent_id"))
    return calls, said.where("role = 'tool'").select("conv_id", F.col("m.tool_call_id").alias("call_id"), "turn", F.col("m.content").alias("content"))


#: Schema of the one tool that turn_calls() derives.
REPLY = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a plain chat: each user turn calls `reply` and needs the call two turns before it; the turn after it is its result.

    So that a plain chat has all that logs of tools have, a rule of conversation and turn gives some calls
    another tool, a turn written as text, arguments that are no JSON, a parent that needs the call in turn, or a
    second copy, and some results a turn before their call.
    """
    turn, conv = F.col("turn").cast("long"), F.col("conv_id")
    name = lambda n: F.concat(F.lit("call-"), n.cast("string"))
    rule = lambda n: F.pmod(conv + turn, F.lit(n))
    plain = F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("prompt")))
    as_text = F.to_json(F.struct(turn.cast("string").alias("turn"), F.col("text").alias("prompt")))
    arguments = F.when(rule(7) == 3, as_text).when(rule(7) == 5, F.concat(F.lit("["), turn)).otherwise(plain)
    parent = F.when((F.pmod(conv, F.lit(13)) == 5) & (F.pmod(turn, F.lit(4)) < 2), turn + 2).otherwise(turn - 2)
    copies = F.when((F.pmod(conv, F.lit(9)) == 4) & (F.pmod(turn, F.lit(4)) == 0), 2).otherwise(1)
    calls = messages.where("role = 'user'").select("conv_id", name(turn).alias("call_id"), turn.alias("turn"), F.when(rule(11) == 4, "lookup").otherwise("reply").alias("name"), arguments.alias("arguments"), name(parent).alias("parent_id"), F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")
    results = messages.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), F.when(F.pmod(conv, F.lit(8)) == 6, turn - 2).otherwise(turn).alias("turn"), F.col("text").alias("content"))
    return calls, results
