"""Links tool calls to their results, orders them, validates the arguments and writes canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.core import prepare

#: Turns of one conversation that are numbered together.
SPAN = 256
_KINDS = {"string": str, "array": list, "object": dict, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def valid(value: object, schema: Mapping) -> bool:
    """JSON Schema's type, enum, const, minimum, maximum, minLength, maxLength, items, minItems, maxItems, required, properties and additionalProperties."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return False
    if isinstance(value, int | float) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(valid(x, schema.get("items", {})) for x in value)
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())):
            return False
        for k, x in value.items():
            if k in known:
                if not valid(x, known[k]):
                    return False
            elif more is False or isinstance(more, Mapping) and not valid(x, more):
                return False
    return True


def canonical(value: object) -> str:
    """JSON with sorted keys and without spaces; characters beyond ASCII as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str | None) -> object:
    """A call's arguments; ValueError if they are no JSON that can be written again: nested beyond Python's limit, NaN, or half a surrogate pair."""
    try:
        value = json.loads(text or "", parse_constant=float)
        canonical(value).encode()
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    return value


def _serialised(schemas: Mapping[str, Mapping]):
    @F.arrow_udf("struct<valid boolean, json string>")
    def run(kind: pa.Array, call_id: pa.Array, name: pa.Array, arguments: pa.Array, content: pa.Array, linked: pa.Array) -> pa.Array:
        out = []
        for k, i, n, a, c, on in zip(*(x.to_pylist() for x in (kind, call_id, name, arguments, content, linked)), strict=True):
            fine, row = None, {"kind": k, "content": c}
            if k == "call":
                try:
                    a = parsed(a)
                    fine = n in schemas and valid(a, schemas[n])
                except ValueError:
                    fine = False  # the text stays as it is
                row = {"kind": k, "id": i, "name": n, "arguments": a, "linked": on}
            elif k == "result":
                row = {"kind": k, "id": i, "content": c, "linked": on}
            out.append({"valid": fine, "json": canonical(row)})
        return pa.array(out, pa.struct([("valid", pa.bool_()), ("json", pa.string())]))

    return run


def link(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """conv_id, turn, kind, call_id, linked, position, valid, json per row of messages (conv_id, turn, kind, call_id, name, arguments, content).

    kind is call, result, or anything else for a plain message. Calls and results are linked by conversation and call_id; a null id
    links nothing. Position counts from 0 within a conversation, in a topological order: by turn, but a result never comes
    before the first call with its id (it follows at that call's turn). Equal turns are ordered by kind, id and content; rows equal in all
    count on. valid is null except for calls: whether the arguments are JSON that the schema of the name accepts. Arguments that are
    no JSON, that are nested beyond Python's limit, or that hold half a surrogate pair are invalid and stay the text they were. Null conversations are one conversation. Other columns are left out.
    """
    prepare(messages.sparkSession)
    plain = messages.select("conv_id", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), "call_id", "name", "arguments", "content")
    calls = plain.filter("kind = 'call' and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    results = plain.filter("kind = 'result' and call_id is not null").groupBy("conv_id", "call_id").agg(F.lit(True).alias("answered"))
    ids = calls.join(results, ["conv_id", "call_id"], "full")
    rows = plain.join(ids, ["conv_id", "call_id"], "left")
    linked = F.when(F.col("kind") == "call", F.coalesce("answered", F.lit(False))).when(F.col("kind") == "result", F.col("call_turn").isNotNull())
    at = F.when((F.col("kind") == "result") & (F.col("call_turn") > F.col("turn")), F.col("call_turn")).otherwise(F.col("turn"))
    rows = rows.withColumns({"linked": linked, "at": at}).withColumns({"span": F.floor(F.col("at") / SPAN), "late": (F.col("kind") == "result").cast("int")})
    counts = rows.groupBy("conv_id", "span").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("conv_id").orderBy(F.col("span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("at", "late", "turn", "kind", "call_id", "content", "arguments"))
    rows = rows.withColumn("inside", inside).join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("span").eqNullSafe(F.col("s")))
    done = _serialised(schemas)("kind", "call_id", "name", "arguments", "content", "linked")
    rows = rows.withColumn("done", done)
    return rows.select("conv_id", "turn", "kind", "call_id", "linked", (F.col("before") + F.col("inside") - 1).cast("long").alias("position"), "done.valid", "done.json")


#: What the conversations' user turns are as calls: their text and turn.
ANSWER = {
    "answer": {
        "type": "object",
        "required": ["query", "turn"],
        "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 4000}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Messages of a chat: a user's turn calls the tool answer, the assistant's next turn is the result, other turns are messages."""
    call_id = lambda turn: F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), turn)
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    arguments = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("query"), "turn"), {"ignoreNullFields": "false"}))
    return conversations.select(
        "conv_id",
        "turn",
        kind.alias("kind"),
        F.when(F.col("role") == "user", call_id(F.col("turn"))).when(F.col("role") == "assistant", call_id(F.col("turn") - 1)).alias("call_id"),
        F.when(F.col("role") == "user", "answer").alias("name"),
        arguments.alias("arguments"),
        F.when(F.coalesce(F.col("role") != "user", F.lit(True)), F.col("text")).alias("content"),
    )
