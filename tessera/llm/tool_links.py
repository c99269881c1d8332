"""Linking of tool calls with their results, in DataFrame functions only.

Calls and results meet in a shuffled hash join on (conv_id, call_id). A call's level is the length of the longest chain of
dependencies before it, and (level, turn, call_id) is a topological order of its conversation. Levels come from the edge
table: a dependency that another one implies goes (the longest chain doesn't use it); a call with one dependency left
points to it, and pointers are doubled until each reaches an anchor, a call with none or several; anchors are then
placed one after the other along their chains. So a chain of a thousand calls takes ten joins, rows stay as many as
calls, and no conversation is ever collected. Arguments are checked against the tool's schema and serialised as canonical
JSON: keys sorted, no blanks, nulls kept. One row per call or orphan result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written


@dataclass(frozen=True)
class Field:
    """A property of a tool's arguments: its JSON type, whether it must be there, bounds of a number or a string's length."""

    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None


#: The schema_of_variant() names of each JSON type.
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def _problems(parsed: Column, fields: list[Field]) -> Column:
    """The fields that break the schema, in its order, as 'name:reason'."""
    found = []
    for f in fields:
        value = F.try_variant_get(parsed, f"$.{f.name}", "variant")
        kind = F.schema_of_variant(value)
        fits = F.lit(False)
        for k in _KINDS[f.kind]:
            fits = fits | F.startswith(kind, F.lit(k))
        size = F.length(F.try_variant_get(parsed, f"$.{f.name}", "string")).cast("double") if f.kind == "string" else F.try_variant_get(parsed, f"$.{f.name}", "double")
        out = F.lit(False)
        if f.least is not None:
            out = out | (size < f.least)
        if f.most is not None:
            out = out | (size > f.most)
        absent = F.lit(f"{f.name}:missing") if f.required else F.lit(None).cast("string")
        found.append(F.when(value.isNull(), absent).when(~fits, F.lit(f"{f.name}:type")).when(out, F.lit(f"{f.name}:range")))
    return F.array_compact(F.array(*found))


_CALL = ["conv_id", "call_id"]


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, after array<string>): the longest chain of dependencies before each.

    Calls on or behind a cycle are left out. Dependencies that are no calls of the conversation are passed over, as are
    repeated ones; a call that waits for itself is a cycle.
    """
    here = calls.select(*_CALL)
    edges = calls.select(*_CALL, F.explode("after").alias("parent")).distinct()
    edges = written(edges.join(here.withColumnRenamed("call_id", "parent").hint("shuffle_hash"), ["conv_id", "parent"]), "edges")
    implied = edges.join(edges.select("conv_id", F.col("call_id").alias("parent"), F.col("parent").alias("before")), ["conv_id", "parent"])
    implied = implied.select(*_CALL, F.col("before").alias("parent")).distinct()
    placed = _placed(here, edges.join(implied, [*_CALL, "parent"], "left_anti"))
    # Where there is a cycle, dependencies may imply each other: then some call isn't over all that it waits for.
    mine, theirs = placed.select(*_CALL, "level"), placed.select("conv_id", F.col("call_id").alias("parent"), F.col("level").alias("below"))
    odd = edges.join(mine, _CALL, "left").join(theirs, ["conv_id", "parent"], "left").where("level is null or below is null or level <= below").select("conv_id").distinct()
    odd = written(odd, "odd")
    if odd.isEmpty():
        return placed
    again = _placed(here.join(odd, "conv_id", "left_semi"), edges.join(odd, "conv_id", "left_semi"))
    return placed.join(odd, "conv_id", "left_anti").unionByName(again)


def _placed(here: DataFrame, edges: DataFrame) -> DataFrame:
    """The levels of all calls that aren't on or behind a cycle of edges (conv_id, call_id, parent)."""
    edges = written(edges.select(*_CALL, "parent"), "edges")
    waits = edges.groupBy(*_CALL).agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    now = here.join(waits, _CALL, "left").select(*_CALL, F.when(single, F.col("parent")).otherwise(F.col("call_id")).alias("up"), F.when(single, 1).otherwise(0).cast("long").alias("far"), (~single).alias("done"))
    now = written(now, "pointers")
    longest = now.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):
        if now.where("not done").isEmpty():
            break
        on = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("done").alias("there"))
        moved = now.where("not done").join(on, ["conv_id", "up"]).select(*_CALL, F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.col("there").alias("done"))
        now, old = written(now.where("done").unionByName(moved), "pointers"), now
        dropped(old)
    now = now.where("done")  # what points on and on is on or behind a cycle
    anchors = now.where("up = call_id").select(*_CALL)
    roots = anchors.join(edges, _CALL, "left_anti").withColumn("level", F.lit(0).cast("long"))
    level = written(roots, "levels")
    several = edges.join(anchors, _CALL, "left_semi")
    left = written(several.join(now.select("conv_id", F.col("call_id").alias("parent"), "up", "far"), ["conv_id", "parent"], "left").select(*_CALL, F.col("up").alias("anchor"), (F.col("far") + 1).alias("far")), "waits")
    while not left.isEmpty():
        met = left.join(level.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"], "left")
        ready = met.groupBy(*_CALL).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("whole")).where("whole").drop("whole")
        ready = written(ready, "levels")
        if ready.isEmpty():
            break
        left, old = written(left.join(ready.select(*_CALL), _CALL, "left_anti"), "waits"), left
        dropped(old)
        level, old = written(level.unionByName(ready), "levels"), level
        dropped(old)
    found = now.join(level.withColumnRenamed("call_id", "up"), ["conv_id", "up"])
    return written(found.select(*_CALL, (F.col("level") + F.col("far")).alias("level")), "levels")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, list[Field]]) -> DataFrame:
    """conv_id, turn, call_id, name, level, status, valid, problems, json: a row per call, and per result without a call.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of call_ids); results: conv_id, turn,
    call_id, content. Of calls that repeat an identifier the first by turn counts, and so for results. status: answered,
    unanswered, early (the result's turn is before the call's), cycle (level null) or orphan (a result alone). valid is
    whether the arguments are a JSON object that fits the tool's schema; problems names what doesn't fit, unknown tools
    and broken JSON (whose text is then serialised as a string). Rows with a null conv_id or call_id are left out.
    """
    first = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))).alias("c")).select("conv_id", "call_id", "c.*")
    first = written(first, "calls")
    answer = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    linked = first.join(answer.hint("shuffle_hash"), _CALL, "full_outer").join(levels(first).hint("shuffle_hash"), _CALL, "left")
    called = F.col("arguments").isNotNull() | F.col("turn").isNotNull() | F.col("name").isNotNull() | F.col("after").isNotNull()
    parsed = F.try_parse_json("arguments")
    linked = linked.withColumn("called", called).withColumn("parsed", parsed).withColumn("shape", F.schema_of_variant("parsed"))
    checks = F.array(F.lit("name:unknown"))
    for name, fields in schemas.items():
        checks = F.when(F.col("name") == name, _problems(F.col("parsed"), fields)).otherwise(checks)
    problems = F.when(~F.col("called"), F.array(F.lit("call:missing"))).when(F.col("shape").isNull() | ~F.startswith("shape", F.lit("OBJECT")), F.array(F.lit("arguments:json"))).otherwise(checks)
    status = F.when(~F.col("called"), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("r").isNull(), "unanswered").when(F.col("r.turn") < F.col("turn"), "early").otherwise("answered")
    at = F.coalesce("turn", "r.turn")
    rest = F.struct(F.col("call_id").alias("id"), "level", "name", F.col("r.content").alias("result"), status.alias("status"), at.alias("turn"))
    quoted = F.to_json(F.struct(F.col("arguments").alias("a")), {"ignoreNullFields": "false"})  # {"a":...}
    body = F.when(F.col("parsed").isNotNull(), F.to_json("parsed")).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))
    text = F.concat(F.lit('{"arguments":'), body, F.lit(","), F.substring(F.to_json(rest, {"ignoreNullFields": "false"}), 2, 2**31 - 1))
    return linked.select("conv_id", at.alias("turn"), "call_id", "name", "level", status.alias("status"), (F.size(problems) == 0).alias("valid"), F.array_join(problems, ",").alias("problems"), text.alias("json"))


#: Tools that a conversation's turns stand for.
SCHEMAS = {
    "configure": [Field("chars", "integer", least=1, most=4000), Field("prompt", "string", least=1)],
    "reply": [Field("chars", "integer", least=1, most=400), Field("lines", "integer", least=1, most=4), Field("prompt", "string", least=1)],
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as calls and results.

    A user turn calls reply, a system turn configure; a call waits for the user or system turn right before it and for
    the one two turns before, where these are. An assistant turn is the result of the turn before it. Null texts stay
    null, which the schemas refuse; other roles are passed over.
    """
    name = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"))
    text = F.col("text")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    shared = [F.length(text).cast("long").alias("chars"), text.alias("prompt")]
    reply = F.to_json(F.struct(shared[1], lines.cast("long").alias("lines"), shared[0]))
    calls = conversations.where(F.col("role").isin("user", "system")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.concat(name, F.col("turn").cast("string")).alias("call_id"),
        F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", reply).otherwise(F.to_json(F.struct(*reversed(shared)))).alias("arguments"),
        F.array(*[F.concat(name, (F.col("turn") - k).cast("string")) for k in (1, 2)]).alias("after"),
    )
    results = conversations.where(F.col("role") == "assistant").select("conv_id", F.col("turn").cast("long").alias("turn"), F.concat(name, (F.col("turn") - 1).cast("string")).alias("call_id"), text.alias("content"))
    return calls, results
