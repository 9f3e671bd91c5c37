"""Chat formatting: link tool calls and results, order them, check arguments, write canonical JSON.

Input is one row a message: ``conv_id, turn, kind`` (call, result or another),
``call_id`` (of a call its own, of a result that of its call), ``parent_id`` (the
call whose result a call builds on, if any), ``name``, ``arguments`` (JSON) and
``content``.

Calls and results meet in a hash join by identifier. Of calls with one
identifier the first by conversation, turn and content counts, the others are
``duplicate``; of its results the first is ``linked``, the others ``extra``.
A result without a call is an ``orphan``, a call without a result is ``open``, a
call without an identifier ``no_id``. Other kinds are ``plain``.

The level of a message is its place in the topological order: a call without a
parent is at 0, a result one above its call, a call one above the result of its
parent. Levels are found by pointer doubling, in as many rounds as the logarithm
of the longest chain. A parent that does not exist, or has no result yet, counts
as none. What is left pointing after enough rounds for the longest possible chain
is a cycle, or hangs on one: status ``cycle``, level null.

Everything runs in DataFrame functions. Null contents count as empty; repeated
rows are each returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch


@dataclass(frozen=True)
class Parameter:
    """What an argument must be: its type, whether it must be there, and the range of a number."""

    type: str
    required: bool = True
    minimum: float | None = None
    maximum: float | None = None


# Names of variant types for each type of a schema.
_TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*$",
    "object": "^OBJECT<.*$",
}


def _argument_errors(arguments: Column, name: str, rule: Parameter) -> list[Column]:
    path = f"$['{name}']"
    value = F.try_variant_get(arguments, path, "variant")
    kind = F.schema_of_variant(value)
    missing = value.isNull()
    wrong = kind.rlike(_TYPES[rule.type])
    errors = [F.when(~missing & ~wrong, F.lit(f"{name}: not {rule.type}"))]
    if rule.required:
        errors.append(F.when(missing, F.lit(f"{name}: missing")))
    number = F.try_variant_get(arguments, path, "double")
    if rule.minimum is not None:
        errors.append(F.when(wrong & (number < rule.minimum), F.lit(f"{name}: below {rule.minimum:g}")))
    if rule.maximum is not None:
        errors.append(F.when(wrong & (number > rule.maximum), F.lit(f"{name}: above {rule.maximum:g}")))
    return errors


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, Parameter]]) -> Column:
    """Errors of a call's arguments against the schema of its tool, as text joined by "; ".

    ``arguments`` is a variant, null where the text is no JSON. An argument that
    the schema lacks is an error.
    """
    is_object = F.schema_of_variant(arguments).startswith("OBJECT<")
    found = F.when(F.coalesce(~is_object, F.lit(True)), F.array(F.lit("arguments: not an object")))
    for tool, parameters in schemas.items():
        known = F.array(*(F.lit(p) for p in parameters)) if parameters else F.array().cast("array<string>")
        extra = F.array_except(F.json_object_keys(F.to_json(arguments)), known)
        checks = [e for p, rule in parameters.items() for e in _argument_errors(arguments, p, rule)]
        unknown = F.transform(F.array_sort(extra), lambda k: F.concat(k, F.lit(": unknown")))
        errors = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), unknown)
        found = found.when(name == tool, errors)
    return F.array_join(found.otherwise(F.array(F.lit("name: unknown tool"))), "; ")


def levels(work: Scratch, calls: DataFrame) -> DataFrame:
    """``(call_id, level)`` of the calls ``(call_id, parent)``, each identifier once; null in a cycle."""
    state = calls.select("call_id", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(2).alias("level"))
    state = work.write(state, "levels")
    rounds = math.ceil(math.log2(max(2, calls.count()))) + 1
    for _ in range(rounds):
        if state.where("at IS NOT NULL").isEmpty():
            break
        ahead = state.select(F.col("call_id").alias("to"), F.col("at").alias("next"), F.col("level").alias("more"))
        moved = state.join(ahead, F.col("at") == F.col("to"), "left").select(
            "call_id", F.col("next").alias("at"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")
        )
        after = work.write(moved, "levels")
        work.drop(state)
        state = after
    return state.select("call_id", F.when(F.col("at").isNull(), F.col("level")).alias("level"))


def _json(row: DataFrame) -> Column:
    """Keys in order, no white space, nulls left out; arguments as they were parsed, keys in order too."""
    kind = F.col("kind")
    call = F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", kind.alias("type"))
    other = F.struct(F.col("content"), F.col("call_id").alias("id"), kind.alias("type"))
    return F.when(kind == "call", F.to_json(call)).otherwise(F.to_json(other))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict[str, Parameter]]) -> DataFrame:
    """``conv_id, turn, kind, call_id, level, status, errors, json``, one row for each message."""
    work = Scratch(messages.sparkSession, "tool-calls")
    text = ("kind", "call_id", "parent_id", "name", "arguments")
    rows = messages.select(
        "conv_id", "turn", *(F.col(c).cast("string").alias(c) for c in text), F.coalesce(F.col("content"), F.lit("")).alias("content")
    )
    # What tells messages of one identifier apart; rows that agree in all of it share their place.
    order = F.struct("conv_id", "turn", F.xxhash64("content", "arguments", "name", "parent_id").alias("tie"))
    rows = work.write(rows.withColumn("place", order), "messages")

    named = rows.where("call_id IS NOT NULL")
    first_call = named.where("kind = 'call'").groupBy("call_id").agg(
        F.min("place").alias("call_place"), F.min_by("parent_id", "place").alias("parent_id")
    )
    first_result = named.where("kind = 'result'").groupBy("call_id").agg(F.min("place").alias("result_place"))
    calls = work.write(first_call.join(first_result, "call_id", "left"), "calls")
    answered = calls.where("result_place IS NOT NULL").select(F.col("call_id").alias("parent"))
    chained = calls.join(answered, F.col("parent_id") == F.col("parent"), "left").select("call_id", "parent")
    found = calls.select("call_id", "call_place", "result_place").join(levels(work, chained), "call_id", "left")
    found = work.write(found.withColumn("called", F.lit(True)), "linked")

    linked = rows.join(found, "call_id", "left").withColumn("parsed", F.try_parse_json("arguments"))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(is_call & F.col("call_id").isNull(), "no_id")
        .when(is_call & (F.col("place") != F.col("call_place")), "duplicate")
        .when(is_result & F.col("called").isNull(), "orphan")
        .when(is_result & (F.col("place") != F.col("result_place")), "extra")
        .when((is_call | is_result) & F.col("level").isNull(), "cycle")
        .when(is_call & F.col("result_place").isNull(), "open")
        .when(is_call | is_result, "linked")
        .otherwise("plain")
    )
    level = F.when(is_call & F.col("called").isNotNull(), F.col("level")).when(is_result & F.col("called").isNotNull(), F.col("level") + 1)
    errors = F.when(is_call, argument_errors(F.col("name"), F.col("parsed"), schemas)).otherwise("")
    return linked.select(
        "conv_id",
        "turn",
        "kind",
        "call_id",
        level.cast("bigint").alias("level"),
        status.alias("status"),
        errors.alias("errors"),
        _json(linked).alias("json"),
    )


# Messages of plain conversations


ANSWER = {"answer": {"chars": Parameter("integer", minimum=1, maximum=1500), "text": Parameter("string")}}


def as_messages(conversations: DataFrame) -> DataFrame:
    """Conversations of ``conv_id, turn, role, text`` as messages.

    An assistant's turn is a call of the tool ``answer`` with its text and length
    as arguments, the user's turn behind it the result; a call builds on the call
    two turns before. Other turns are plain.
    """
    role, turn = F.col("role"), F.col("turn")
    content = F.coalesce(F.col("text"), F.lit(""))

    def identifier(back):
        return F.concat_ws(":", F.col("conv_id").cast("string"), (turn - back).cast("string"))

    known = F.col("conv_id").isNotNull() & turn.isNotNull()
    is_call, is_result = role == "assistant", role == "user"
    arguments = F.to_json(F.struct(content.alias("text"), F.length(content).alias("chars")))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(is_call, "call").when(is_result, "result").otherwise(F.coalesce(role, F.lit("unknown"))).alias("kind"),
        F.when(known & is_call, identifier(0)).when(known & is_result, identifier(1)).alias("call_id"),
        F.when(known & is_call, identifier(2)).alias("parent_id"),
        F.when(is_call, "answer").alias("name"),
        F.when(is_call, arguments).alias("arguments"),
        F.when(~F.coalesce(is_call, F.lit(False)), content).alias("content"),
    )


def link_conversations(conversations: DataFrame) -> DataFrame:
    return link_tool_calls(as_messages(conversations), ANSWER)
