"""Linking tool calls with their results and writing chats as canonical JSON.

Calls and results are hash-joined by conversation and call id. Calls come in topological order: a call follows the
calls it depends on, otherwise the order of turns; a call's place is the greatest of its own turn and the places of
what it depends on, found by rounds of joins that only references to the same or a later turn make necessary.
Arguments are parsed and checked against the tool's schema (type, required, properties, enum, minimum, maximum,
minLength, maxLength, items, additionalProperties). Each event becomes one line of canonical JSON: sorted keys, no
blanks, the shortest form of numbers.

Defined results: of calls that share an id the first (by turn, then text) is linked, others have the status
``duplicate_call``; of several results for a call the first is linked, others are ``duplicate_result``; a result
without a call is ``orphan_result``; a call without a result has null output. A dependency on an unknown call is
reported, not followed; calls in a cycle have the status ``cyclic`` and keep the place of their turn. Very long arguments and contents
are read whole. Equal rows count as several: one is first. Null or invalid
arguments give ``invalid_arguments`` with the reasons. Null ids link with nothing. Empty tables give an empty result.
Only the named columns are read, so other columns may have any name. No conversation is gathered in one task: places are
running totals in two levels, first rows are minima, and an id that very many rows name is no hot key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import Scratch, join_counted, prefix_sum

TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    def plain(x: Any) -> Any:
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
            return int(x)
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def faults(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema, in a fixed order."""
    kinds = schema.get("type")
    if kinds:
        wanted = [kinds] if isinstance(kinds, str) else kinds
        whole = isinstance(value, float) and value.is_integer()  # 1.0 is an integer in JSON
        fits = any((isinstance(value, TYPES[k]) or k == "integer" and whole) and not (isinstance(value, bool) and k in ("number", "integer")) for k in wanted)
        if not fits:
            return [f"{at}: not of type {'/'.join(wanted)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{at}[{i}]")
    return out


def places(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, place, cyclic): place is (turn, hops), later than the places of all known dependencies.

    A call stands at its own turn until something it depends on stands later; only calls that moved in a round are looked
    at in the next. A path of more hops than calls that ever moved in its conversation goes round a cycle.
    """
    own = calls.select("conv_id", "call_id", F.struct("turn", F.lit(0).alias("hops")).alias("own"))
    edges = scratch.put(calls.select("conv_id", "call_id", F.explode("after").alias("needs")).distinct(), "needs")
    asked = edges.groupBy("conv_id", "needs").agg(F.count(F.lit(1)).alias("_n"))
    n = edges.count()
    turns = own.select("conv_id", F.col("call_id").alias("needs"), F.col("own.turn").alias("_needs_turn")).join(asked, ["conv_id", "needs"])
    known = join_counted(edges, turns, ["conv_id", "needs"], n).join(own.select("conv_id", "call_id", F.col("own.turn").alias("_turn")), ["conv_id", "call_id"])
    known = scratch.put(known, "edges")
    at_turn = F.struct(F.col("_turn").alias("turn"), F.lit(0).alias("hops"))
    first = known.groupBy("conv_id", "call_id").agg(F.max(F.struct(F.col("_needs_turn").alias("turn"), F.lit(1).alias("hops"))).alias("place"), F.first("_turn").alias("_turn"))
    first = first.where(F.col("place") > at_turn).select("conv_id", "call_id", "place", F.lit(False).alias("cyclic"), F.lit(True).alias("new"))
    moved, k = scratch.put(first, "moved-0"), 0
    while moved.where("new").head(1):
        k += 1
        frontier = moved.where("new").select("conv_id", F.col("call_id").alias("needs"), "place", "cyclic").join(asked, ["conv_id", "needs"])
        pushed = join_counted(known, frontier, ["conv_id", "needs"], n).groupBy("conv_id", "call_id").agg(
            F.max(F.struct("place.turn", (F.col("place.hops") + 1).alias("hops"))).alias("_to"), F.bool_or("cyclic").alias("_c"), F.first("_turn").alias("_turn")
        )
        both = moved.drop("new").join(pushed, ["conv_id", "call_id"], "full_outer")
        was, now = F.coalesce("cyclic", F.lit(False)), F.coalesce("place", at_turn)
        up = F.coalesce(F.col("_to") > now, F.lit(False)) & ~was
        both = both.select("conv_id", "call_id", F.when(up, F.col("_to")).otherwise(now).alias("place"), was.alias("_was"), up.alias("_up"), F.coalesce("_c", F.lit(False)).alias("_c"), F.col("place").isNotNull().alias("_had"))
        both = scratch.put(both.where("_had or _up or _c"), f"both-{k}")
        counts = both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"), F.count(F.lit(1)).alias("_moved"))
        rows = join_counted(both, counts, ["conv_id"], both.count())
        cyclic = F.col("_was") | F.col("_c") | (F.col("place.hops") > F.col("_moved"))
        moved = scratch.put(rows.select("conv_id", "call_id", "place", cyclic.alias("cyclic"), (~F.col("_was") & (cyclic | F.col("_up"))).alias("new")), f"moved-{k}")
        scratch.drop(f"both-{k}")
        scratch.drop(f"moved-{k - 1}")
    cyclic = F.coalesce("cyclic", F.lit(False))
    out = own.join(moved.select("conv_id", "call_id", "place", "cyclic"), ["conv_id", "call_id"], "left")
    return out.select("conv_id", "call_id", F.when(cyclic, F.col("own")).otherwise(F.coalesce("place", "own")).alias("place"), cyclic.alias("cyclic"))


def first_marked(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Rows with ``_first``: whether a row is the first of its conversation and call id; null without these."""
    rows = scratch.put(rows.withColumn("_uid", F.monotonically_increasing_id()), name)
    keyed = rows.where("conv_id is not null and call_id is not null")
    least = keyed.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order, "_uid")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    marked = join_counted(keyed, least.select("conv_id", "call_id", F.col("_m._uid").alias("_least"), "_n"), ["conv_id", "call_id"], keyed.count())
    marked = marked.withColumn("_first", F.col("_uid") == F.col("_least")).drop("_least", "_uid")
    return scratch.put(marked.unionByName(rows.where("conv_id is null or call_id is null").drop("_uid"), allowMissingColumns=True), f"{name}-marked")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], *, scratch: Scratch | None = None) -> DataFrame:
    """One row per call and result: (conv_id, position, turn, call_id, status, problems, json).

    ``calls`` has (conv_id, turn, call_id, name, arguments as JSON text, after: array of call ids); ``results`` has
    (conv_id, turn, call_id, content). ``schemas`` are a parameter, one for each tool.
    """
    scratch = scratch or Scratch(calls.sparkSession, "toolcalls")
    calls = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    results = results.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "content")
    ranked = first_marked(calls, ["turn", "name", "arguments"], "calls", scratch)
    first = ranked.where("_first is null or _first")
    got = first_marked(results, ["turn", "content"], "results", scratch)
    placed = places(first.where("call_id is not null and conv_id is not null"), scratch)
    linked = first.join(got.where("_first").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content"), ["conv_id", "call_id"], "left")
    linked = linked.join(placed, ["conv_id", "call_id"], "left")
    wanted = first.select("conv_id", F.col("call_id"), F.explode("after").alias("needs")).join(first.select("conv_id", F.col("call_id").alias("needs")).distinct(), ["conv_id", "needs"], "left_anti")
    unknown = wanted.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("needs")).alias("unknown"))
    linked = linked.join(unknown, ["conv_id", "call_id"], "left")
    columns = ["conv_id", "turn", "call_id", "name", "arguments", "content", "result_turn", "after", "unknown"]
    turn_place = F.struct("turn", F.lit(0).alias("hops"))
    parts = linked.select(*columns, F.coalesce("place", turn_place).alias("place"), F.when(F.col("cyclic"), "cyclic").otherwise("call").alias("status"))
    more = ranked.where("not _first").select("conv_id", "turn", "call_id", "name", "arguments", "after", turn_place.alias("place"), F.lit("duplicate_call").alias("status"))
    # Results of one id are as many as share it; a call that has very many is no hot key.
    shared = got.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("_n"))
    known = first.where("_first").select("conv_id", "call_id").join(shared, ["conv_id", "call_id"])
    answered = join_counted(got, known.withColumn("_known", F.lit(True)), ["conv_id", "call_id"], got.count())
    lost = got.join(known, ["conv_id", "call_id"], "left_anti").withColumn("_known", F.lit(None).cast("boolean"))
    rest = answered.unionByName(lost).where("not _first or _known is null")
    rest = rest.select("conv_id", "turn", "call_id", "content", turn_place.alias("place"), F.when(F.col("_known"), "duplicate_result").otherwise("orphan_result").alias("status"))
    events = parts.unionByName(more, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)

    schema = "conv_id long, turn long, call_id string, status string, problems array<string>, json string, place_turn long, hops long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                status, problems = r["status"], []
                body: dict[str, Any] = {"id": r["call_id"]}
                if status in ("call", "cyclic", "duplicate_call"):
                    try:
                        arguments = json.loads(r["arguments"]) if r["arguments"] is not None else None
                        canonical(arguments)
                    except (ValueError, RecursionError):
                        arguments, problems = None, ["$: not JSON"]
                    if not problems:
                        problems = faults(arguments, schemas[r["name"]]) if r["name"] in schemas else ["unknown tool"]
                    problems += [f"unknown dependency {x}" for x in r["unknown"] or ()]
                    body |= {"name": r["name"], "arguments": arguments, "after": sorted(r["after"] or ())}
                    if status == "call" and problems:
                        status = "invalid_arguments"
                    if status != "duplicate_call":
                        body["result"] = r["content"]
                else:
                    body["result"] = r["content"]
                out.append((r["conv_id"], r["turn"], r["call_id"], status, problems, canonical(body), r["place"]["turn"], r["place"]["hops"]))
            columns_ = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds)], ["conv_id", "turn", "call_id", "status", "problems", "json", "place_turn", "hops"])

    written = events.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(write, schema)
    written = scratch.put(written.withColumn("_run", F.expr("place_turn div 4096")).withColumn("_one", F.lit(1)).withColumn("_conv", F.coalesce("conv_id", F.lit(-(1 << 62)))), "events")
    ordered = prefix_sum(written, ["_conv"], "_run", ["place_turn", "hops", "turn", "status", "call_id", "json"], "_one", "position")
    return ordered.select("conv_id", F.col("position").cast("long").alias("position"), "turn", "call_id", "status", "problems", "json")


#: What turns of plain conversations are read as.
TOOLS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "words"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 300}, "words": {"type": "integer", "minimum": 1}},
    },
    "configure": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string"}}},
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text), by rules on their content.

    A user turn is a call of ``reply``, a system turn a call of ``configure``; an assistant turn is the result of the
    call one turn before it, or of none. A call's id is its role's initial and the first hexadecimal digit of the MD5
    of its text, so ids of a conversation can clash. With c the CRC-32 of its text, a user's call depends on the call two
    turns before (c mod 4 = 0), two turns later (1) or four turns before (2), or, where no call stands there, on an unknown id;
    the number of words is text where c mod 7 = 0 and the arguments are no JSON where c mod 11 = 0. Other roles are neither.
    """
    text = F.coalesce("text", F.lit(""))
    code = F.crc32(text.cast("binary"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    asked = rows.where("role in ('user', 'system')").withColumn("call_id", F.concat(F.substring("role", 1, 1), F.lit(":"), F.substring(F.md5(text), 1, 1)))
    ids = asked.groupBy("conv_id", "turn").agg(F.min("call_id").alias("_id"))
    step = F.when(code % 4 == 0, -2).when(code % 4 == 1, 2).when(code % 4 == 2, -4)
    asked = asked.withColumn("_at", F.when(F.col("role") == "user", F.col("turn") + step))
    there = ids.select("conv_id", F.col("turn").alias("_at"), F.col("_id").alias("_needs"))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    prompt = F.col("text").alias("prompt")
    arguments = (
        F.when(F.col("role") == "system", F.to_json(F.struct(prompt)))
        .when(code % 11 == 0, F.concat(F.lit('{"prompt": '), text))
        .when(code % 7 == 0, F.to_json(F.struct(prompt, words.cast("string").alias("words"))))
        .otherwise(F.to_json(F.struct(prompt, words.alias("words"))))
    )
    calls = asked.join(there, ["conv_id", "_at"], "left").select(
        "conv_id", "turn", "call_id", F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"), arguments.alias("arguments"),
        F.when(F.col("_at").isNotNull(), F.array(F.coalesce("_needs", F.concat(F.lit("turn:"), F.col("_at").cast("string"))))).alias("after"),
    )
    before = ids.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("_id").alias("call_id"))
    results = rows.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "call_id", F.col("text").alias("content"))
    return calls, results
