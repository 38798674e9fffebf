"""Chat formatting (operator 8), in DataFrame functions only: tool calls linked with their results.

Steps.  Calls and results of a conversation are linked by a shuffled hash join on (conversation, call id), so that even one
huge conversation is spread.  Calls may cite results of others, ``{"$result": "<call id>"}`` anywhere in their arguments; the
depth of a call is one more than that of the deepest result it cites, else 0, and of a result one more than of its call.
Depths are found in rounds that each settle the events whose sources are settled (Kahn's order); (depth, turn, seq) is a
topological order of each conversation.  Arguments are checked against the schema of their tool.  Each event is written as
canonical JSON: keys in order, no white space, equal values written alike (arguments pass through VARIANT, which sorts keys).

Messages.  An assistant text that is a JSON object with ``tool_calls`` (id, name, arguments) is calls, a text of role
``tool`` with ``tool_call_id`` is a result; others are plain.  ``turns_as_calls`` reads plain dialogues: a user's turn is a
call of the tool ``ask``, the assistant's turn right after it is the result.

Cases: repeated ids: every call row is an event of its own, all results of an id are linked with it, and the first one
counts as its answer; a result without a call has depth null and is not linked; a call that cites a missing result, or is on a
cycle, has depth null; null or empty texts are null or empty contents; broken JSON is a plain message; extra columns and
empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.common import stored

KEYS = ["conv_id", "call_id"]
CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"
RESULT = "struct<tool_call_id: string, content: string>"
CITED = r'"\$result"\s*:\s*"([^"]+)"'
#: JSON type names by the names that VARIANT uses.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
#: Schema of the tool that ``turns_as_calls`` calls.
ASK = {"ask": {"properties": {"text": {"type": "string", "min_length": 1}, "turn": {"type": "integer"}}, "required": ["text", "turn"]}}

def events_of(messages: DataFrame) -> DataFrame:
    """One row for each call, result or plain message in (conv_id, turn, role, text)."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    m = m.withColumn("calls", F.when(F.col("role") == "assistant", F.from_json("text", CALLS)["tool_calls"])).withColumn("result", F.when(F.col("role") == "tool", F.from_json("text", RESULT)))
    none = F.lit(None).cast("string")

    def event(kind: str, call_id: Column = none, name: Column = none, arguments: Column = none, content: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), content.alias("content"))

    events = (
        F.when(F.size("calls") > 0, F.transform("calls", lambda c: event("call", c["id"], c["name"], c["arguments"])))
        .when(F.col("result.tool_call_id").isNotNull(), F.array(event("result", F.col("result.tool_call_id"), content=F.col("result.content"))))
        .otherwise(F.array(event("message", content=F.col("text"))))
    )
    return m.select("conv_id", "turn", "role", F.posexplode(events).alias("seq", "e")).select("conv_id", "turn", "seq", "role", "e.*")


def turns_as_calls(events: DataFrame) -> DataFrame:
    """Plain user turns as calls of ``ask``, plain assistant turns as the results of the turn before."""
    plain = F.col("kind") == "message"
    ask, answer = plain & (F.col("role") == "user"), plain & (F.col("role") == "assistant")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    return events.select(
        "conv_id",
        "turn",
        "seq",
        F.when(ask, "call").when(answer, "result").otherwise(F.col("kind")).alias("kind"),
        "role",
        F.when(ask, name(F.col("turn"))).when(answer, name(F.col("turn") - 1)).otherwise(F.col("call_id")).alias("call_id"),
        F.when(ask, "ask").otherwise(F.col("name")).alias("name"),
        F.when(ask, F.to_json(F.struct(F.col("content").alias("text"), "turn"))).otherwise(F.col("arguments")).alias("arguments"),
        F.when(~ask, F.col("content")).alias("content"),
    )


def problems(schemas: dict[str, dict]) -> Column:
    """What is wrong with each row's ``arguments`` under the schema of its tool, as an array of short texts."""
    value = F.try_parse_json("arguments")
    checks = [F.when(value.isNull(), "not JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object")]
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        own = list(checks)
        for field, rule in schema.get("properties", {}).items():
            path = f"$['{field}']"
            kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            found = F.coalesce(kind != "VOID", F.lit(False))
            if field in schema.get("required", ()):
                own.append(F.when(value.isNotNull() & ~found, f"{field}: missing"))
            cited = F.try_variant_get(value, f"{path}['$result']", "string").isNotNull()  # known only when the result is there
            own.append(F.when(found & ~cited & ~kind.rlike(f"^({TYPES[rule['type']]})$"), f"{field}: not {rule['type']}"))
            if "min_length" in rule:
                own.append(F.when(found & ~cited & (F.length(F.try_variant_get(value, path, "string")) < rule["min_length"]), f"{field}: too short"))
        known = list(schema.get("properties", {}))
        own.append(F.when(F.size(F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), F.lit(known))) > 0, "unknown field"))
        out = F.when(F.col("name") == tool, F.array_compact(F.array(*own))).otherwise(out)
    return out


def with_depths(events: DataFrame) -> DataFrame:
    """Adds ``depth`` and ``linked``; see above."""
    calls = events.where("kind = 'call'")
    cites = calls.select(*KEYS, F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(CITED)))).alias("cited")).distinct()
    answered = events.where("kind = 'result'").groupBy(*KEYS).agg(F.count("*").alias("results"))
    called = calls.groupBy(*KEYS).agg(F.count("*").alias("calls"))
    both = called.join(answered.hint("shuffle_hash"), KEYS, "full_outer")
    if cites.isEmpty():
        known = both.withColumn("depth", F.when(F.col("calls").isNotNull(), F.lit(0)))
    else:
        # ids that cite something wait for a settled depth of all they cite; the others have depth 0
        waiting = stored(cites, "cites")
        settled = stored(called.join(waiting.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS, F.lit(0).alias("depth")), "depths")
        sources = settled.join(answered, KEYS).select("conv_id", F.col("call_id").alias("cited"), "depth")
        while True:
            more = waiting.join(sources, ["conv_id", "cited"], "left").groupBy(*KEYS).agg(F.max("depth").alias("depth"), F.count_if(F.col("depth").isNull()).alias("open")).where("open = 0").select(*KEYS, (F.col("depth") + 2).alias("depth"))
            more = stored(more.join(settled.select(*KEYS), KEYS, "left_anti"), "depths")
            if more.isEmpty():
                break
            settled = stored(settled.unionByName(more), "depths")
            sources = settled.join(answered, KEYS).select("conv_id", F.col("call_id").alias("cited"), "depth")
        known = both.join(settled, KEYS, "left")
    tool = events.where("kind <> 'message'").join(known, KEYS, "left")
    tool = tool.withColumn("linked", F.col("calls").isNotNull() & F.col("results").isNotNull()).withColumn("depth", F.when(F.col("kind") == "call", F.col("depth")).otherwise(F.col("depth") + 1)).drop("calls", "results")
    return tool.unionByName(events.where("kind = 'message'").withColumn("linked", F.lit(False)).withColumn("depth", F.lit(0)))


def formatted(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, seq, kind, call_id, depth, linked, valid, problems, json) of every event."""
    e = with_depths(events).withColumn("problems", F.when(F.col("kind") == "call", problems(schemas)))
    # fields in the order of their names; null ones are left out; arguments that are no JSON are kept as they stand
    call = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.when(F.try_parse_json("arguments").isNull(), F.col("arguments")).alias("arguments_text"), "call_id", "name", "role"))
    rest = F.to_json(F.struct("call_id", "content", "role"))
    return e.select("conv_id", "turn", "seq", "kind", "call_id", "depth", "linked", (F.size("problems") == 0).alias("valid"), "problems", F.when(F.col("kind") == "call", call).otherwise(rest).alias("json"))


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None, dialogues: bool = True) -> DataFrame:
    """All messages linked, ordered, validated and serialised; ``dialogues``: with ``turns_as_calls``."""
    events = events_of(messages)
    return formatted(turns_as_calls(events) if dialogues else events, {**(schemas or {}), **(ASK if dialogues else {})})
