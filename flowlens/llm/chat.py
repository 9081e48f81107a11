"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

#: A call refers to another call of its conversation by this mark in its arguments.
REFERENCE = r"\$\{([^}]+)\}"


class Param(NamedTuple):
    name: str
    kind: str                     #: string, integer, number, boolean, array or object
    required: bool = False
    least: float | None = None    #: for numbers
    most: float | None = None


_KINDS = {"string": r"^STRING", "integer": r"^BIGINT", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": r"^BOOLEAN",
          "array": r"^ARRAY", "object": r"^OBJECT"}


def errors(arguments: Column, name: Column, tools: dict[str, tuple[Param, ...]]) -> Column:
    """Sorted list of what is wrong with the arguments (a variant; NULL if they were no JSON) of a call."""
    nothing = F.array().cast("array<string>")
    checks = F.when(~name.isin(*tools) | name.isNull(), F.array(F.lit("unknown tool")))
    for tool, params in tools.items():
        found = []
        for p in params:
            value = F.try_variant_get(arguments, f"$.{p.name}", "variant")
            kind = F.schema_of_variant(value)
            missing = value.isNull() | (kind == "VOID")
            found.append(F.when(missing, F.lit(f"{p.name}: missing") if p.required else F.lit(None))
                         .when(~F.rlike(kind, F.lit(_KINDS[p.kind])), F.lit(f"{p.name}: not {p.kind}")))
            number = F.try_variant_get(arguments, f"$.{p.name}", "double")
            for limit, wrong, text in ((p.least, number < F.lit(p.least), "too small"), (p.most, number > F.lit(p.most), "too large")):
                if limit is not None:
                    found.append(F.when(wrong, F.lit(f"{p.name}: {text}")))
        extra = F.transform(F.array_except(F.json_object_keys(F.to_json(arguments)), F.array(*(F.lit(p.name) for p in params))),
                            lambda k: F.concat(k, F.lit(": unknown")))
        each = F.array_sort(F.concat(F.array_compact(F.array(*found)), F.coalesce(extra, nothing)))
        checks = checks.when((name == tool) & F.rlike(F.schema_of_variant(arguments), F.lit("^OBJECT")), each)
    return F.when(arguments.isNull(), F.array(F.lit("no JSON"))).otherwise(F.coalesce(checks, F.array(F.lit("no object"))))


def _quoted(c: Column) -> Column:
    """A value as JSON; ``null`` for NULL."""
    return F.coalesce(F.to_json(F.try_parse_json(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))), F.lit("null"))


def _object(parts: list[tuple[str, Column]]) -> Column:
    """A JSON object of names and written values."""
    body = functools.reduce(lambda a, b: F.concat(a, F.lit(","), b), (F.concat(F.lit(f'"{k}":'), v) for k, v in parts))
    return F.concat(F.lit("{"), body, F.lit("}"))


def _levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, id, level): 0 without known references, else one more than the highest reference; calls in or behind a cycle are missing.

    One round per level: a call is placed once all it refers to are placed.
    """
    placed = materialize(calls.join(needs, ["conv", "id"], "left_anti").select("conv", "id", F.lit(0).alias("level")))
    newest, level = placed, 0
    while not newest.isEmpty():
        level += 1
        touched = needs.join(newest.select("conv", F.col("id").alias("on")), ["conv", "on"], "left_semi").select("conv", "id").distinct()
        ready = needs.join(touched, ["conv", "id"], "left_semi") \
            .join(placed.select("conv", F.col("id").alias("on"), F.col("level").alias("at")), ["conv", "on"], "left") \
            .groupBy("conv", "id").agg(F.bool_and(F.col("at").isNotNull()).alias("all")).where("all")
        newest = materialize(ready.select("conv", "id", F.lit(level).alias("level")))
        placed = placed.unionByName(newest)
    return placed


def link(calls: DataFrame, results: DataFrame, tools: dict[str, tuple[Param, ...]]) -> DataFrame:
    """Exchanges of tool calls and results, one row per call and per result without a call.

    ``calls``: conv, turn, id, name, arguments (JSON text). ``results``: conv,
    turn, id, text. Gives ``conv``, ``id``, ``level``, ``call_turn``,
    ``result_turn``, ``status``, ``errors`` (comma-joined), ``json``; within a
    conversation the topological order is (level, call_turn, id).

    Calls and results meet in a hash join on (conversation, id). Of several
    calls with an id the earliest counts, and so of results; ties go by
    content. status: ``orphan`` (a result without a call), ``cycle`` (no level
    exists), ``invalid`` (its arguments break the tool's schema), ``open``
    (no result), else ``ok``, the first that holds. References to ids that are
    no calls of the conversation are errors and do not count for the order; a
    reference to itself is a cycle.

    JSON is canonical: keys sorted at every depth, no white space; arguments
    that are no JSON stand in it as a string. Rows with a NULL conversation or
    id, repeated rows and NULL texts: NULL keys are left out, as they name
    nothing; repeats collapse; a NULL result text counts as empty. Empty tables give an
    empty result; other columns are not read. No step gathers a conversation:
    groups are single ids, and one job runs per level, not per call.
    """
    first = lambda df, *content: df.where("conv is not null and id is not null").groupBy("conv", "id") \
        .agg(F.min(F.struct("turn", *content)).alias("x")).select("conv", "id", "x.*")
    calls = materialize(first(calls, "name", "arguments"))
    results = first(results.withColumn("text", F.coalesce("text", F.lit(""))), "text")
    refs = calls.select("conv", "id", F.explode(F.array_distinct(F.regexp_extract_all(
        F.coalesce("arguments", F.lit("")), F.lit(REFERENCE), F.lit(1)))).alias("on"))
    known = calls.select("conv", F.col("id").alias("on"), F.lit(True).alias("known"))
    refs = materialize(refs.join(known, ["conv", "on"], "left"))
    levels = _levels(calls, refs.where("known").drop("known"))
    lost = refs.where("known is null").groupBy("conv", "id").agg(F.sort_array(F.collect_list(
        F.concat(F.col("on"), F.lit(": no such call")))).alias("lost"))
    both = calls.withColumn("variant", F.try_parse_json("arguments")).withColumnRenamed("turn", "call_turn").withColumn("called", F.lit(True)) \
        .join(results.withColumnRenamed("turn", "result_turn").withColumn("answered", F.lit(True)), ["conv", "id"], "full") \
        .join(levels, ["conv", "id"], "left").join(lost, ["conv", "id"], "left")
    wrong = F.when(F.col("called"), F.concat(errors(F.col("variant"), F.col("name"), tools),
                                             F.coalesce("lost", F.array().cast("array<string>"))))
    both = both.withColumn("wrong", wrong)
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("level").isNull(), "cycle") \
        .when(F.size("wrong") > 0, "invalid").when(F.col("answered").isNull(), "open").otherwise("ok")
    parts = [("arguments", F.coalesce(F.to_json("variant"), _quoted(F.col("arguments")))), ("conversation", _quoted(F.col("conv"))),
             ("id", _quoted(F.col("id"))), ("level", F.coalesce(F.col("level").cast("string"), F.lit("null"))),
             ("name", _quoted(F.col("name"))), ("result", _quoted(F.col("text"))), ("status", F.concat(F.lit('"'), F.col("status"), F.lit('"')))]
    return both.withColumn("status", status).select(
        "conv", "id", "level", "call_turn", "result_turn", "status", F.coalesce(F.array_join("wrong", ","), F.lit("")).alias("errors"),
        _object(parts).alias("json"))


#: Tool of the dialogue form: a user's turn calls it, the assistant's next turn is the result.
DIALOGUE = {"answer": (Param("query", "string", True), Param("words", "integer", True, 1, 60), Param("after", "string"))}


def from_dialogue(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user's turn t is the call ``conv:t`` of ``answer`` with the text, its
    number of words and, from turn 2 on, a reference to the turn t div 2; the
    assistant's turn t is the result of ``conv:t-1``.
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    base = messages.select(F.col("conv_id").alias("conv"), "conv_id", "turn", "role", "text")
    half = F.floor(F.col("turn") / 2)
    calls = base.where("role = 'user'").select("conv", "turn", name(F.col("turn")).alias("id"), F.lit("answer").alias("name"), F.to_json(F.struct(
        F.size(F.filter(F.split(F.col("text"), " "), lambda w: w != "")).alias("words"), F.col("text").alias("query"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("${"), name(half), F.lit("}"))).alias("after"))).alias("arguments"))
    results = base.where("role = 'assistant'").select("conv", "turn", name(F.col("turn") - 1).alias("id"), "text")
    return calls, results


def other_turns(messages: DataFrame) -> DataFrame:
    """The turns that `from_dialogue` does not take (any other role or none), one row each, in the columns of `link`.

    ``status`` is ``context``, ``call_turn`` the turn; role and text stand in the JSON.
    """
    other = messages.where("role is null or role not in ('user', 'assistant')")
    name = F.concat_ws(":", F.col("conv_id"), F.col("turn"))
    parts = [("conversation", _quoted(F.col("conv_id"))), ("id", _quoted(name)), ("role", _quoted(F.col("role"))),
             ("status", F.lit('"context"')), ("text", _quoted(F.col("text"))), ("turn", _quoted(F.col("turn")))]
    return other.select(F.col("conv_id").alias("conv"), name.alias("id"), F.lit(None).cast("int").alias("level"), F.col("turn").alias("call_turn"),
                        F.lit(None).cast(messages.schema["turn"].dataType).alias("result_turn"), F.lit("context").alias("status"),
                        F.lit("").alias("errors"), _object(parts).alias("json"))


def dialogue(messages: DataFrame) -> DataFrame:
    """Plain conversations as one result: the exchanges of `link` and all other turns."""
    return link(*from_dialogue(messages), DIALOGUE).unionByName(other_turns(messages))
