"""Tool calls in chats: linked to their results, ordered by what they need, validated and serialised.

Calls and results are hash-joined by conversation and identifier. A call stands after all calls it
needs: its key is the latest turn among itself and what it needs, directly or not, and calls of equal key
(those that a later turn holds back) are peeled in levels. Both are fixpoints of equi-joins and grouped
maxima over the table of needs, so no conversation is gathered in one task; a log in which calls only need earlier ones
settles in one round. Arguments are validated against the tool's schema and everything is written as
canonical JSON: sorted keys, no spaces, no escapes but those that JSON demands.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed, written

KINDS = {
    "string": lambda v: isinstance(v, str), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict),
}


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """What a JSON value breaks of a schema: type, enum, required, properties, additionalProperties, items, lengths and bounds."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(KINDS[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += schema_errors(v, schema["items"], f"{at}[{i}]")
    size = len(value) if isinstance(value, (str, list)) else None
    for name, bad in (("minLength", lambda n: size < n), ("maxLength", lambda n: size > n)):
        if name in schema and isinstance(value, str) and bad(schema[name]):
            found.append(f"{at}: {name}")
    if KINDS["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{at}: minimum")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{at}: maximum")
    return found


def canonical(value) -> str:
    """JSON with sorted keys and without spaces; numbers that are whole have no fraction."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    if not math.isfinite(value):
        raise ValueError(f"{digits} is too large")
    return value


#: Lists and objects within each other; deeper arguments are invalid.
DEEPEST = 100


def _deep(value) -> bool:
    level = [value]
    for _ in range(DEEPEST + 1):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return False
    return True


def _checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """The arguments' value and what is wrong with it; no text makes it fail."""
    try:
        value = json.loads(arguments if arguments is not None else "{}", parse_constant=_no_constant, parse_float=_finite)
        if _deep(value):
            return None, ["arguments: too deep"]
        canonical(value).encode("utf-8")  # half a surrogate pair is no character
    except (ValueError, RecursionError):
        return None, ["arguments: not JSON"]
    if name not in schemas:
        return value, [f"unknown tool: {name}"]
    return value, schema_errors(value, schemas[name])


#: No way is counted longer; only circles are.
LONGEST = 1 << 40


def _step(values: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``values(k, value, was)`` and ``edges(k, need, way)`` one round on, and the edges that led to where none goes on.

    A value becomes the largest of what its edges lead to, their ways added. Then an edge that leads to where one edge goes on leads where that one does, so ways along a chain double in length each
    round; one that leads to where none goes on has told all and goes.
    """
    on = edges.groupBy(F.col("k").alias("at")).agg(F.count("*").alias("n"), F.max(F.struct("need", "way")).alias("next"))
    met = written(edges.join(values.select(F.col("k").alias("of"), F.col("value").alias("theirs")), F.col("need") == F.col("of")).join(on, F.col("need") == F.col("at"), "left").select("k", "need", "way", "theirs", "n", "next"))
    told = met.groupBy(F.col("k").alias("of")).agg(F.max(F.col("way") + F.col("theirs")).alias("told"))
    values = values.join(told, F.col("k") == F.col("of"), "left").select("k", F.greatest("value", "told").alias("value"), F.col("value").alias("was"))
    single = F.col("n") == 1
    further = F.least(F.col("way") + F.col("next.way"), F.lit(LONGEST))
    edges = met.where("n is not null").select("k", F.when(single, F.col("next.need")).otherwise(F.col("need")).alias("need"), F.when(single, further).otherwise(F.col("way")).alias("way"))
    return written(values), written(edges.groupBy("k", "need").agg(F.max("way").alias("way"))), met.where("n is null")


def _ordered(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``(k, key, level)`` of each call; level is null for calls that need each other in a circle, and for what needs them.

    Chains of any length and shape settle in a number of rounds that grows with the logarithm of their length; needs that branch and meet again take at most as many as their longest way has branchings.
    """
    edges = written(needs.where("k <> need").select("k", "need", F.lit(0).cast("long").alias("way")).distinct())
    values = written(calls.select("k", F.col("turn").alias("value")))
    while not edges.isEmpty():
        values, edges, _ = _step(values, edges)
        if values.where("value > was").isEmpty():
            break
        edges = edges.where("k <> need")
    keys = written(values.select("k", F.col("value").alias("key")))
    theirs = keys.select(F.col("k").alias("need"), F.col("key").alias("theirs"))
    edges = needs.select("k", "need").distinct().join(keys, "k").join(theirs, "need").where("key = theirs").select("k", "need", F.lit(1).cast("long").alias("way"))
    edges = written(edges)
    values = written(keys.select("k", F.lit(0).cast("long").alias("value")))
    while not edges.isEmpty():
        values, edges, last = _step(values, edges)
        if last.isEmpty():  # what is left leads into circles
            break
    circular = edges.select(F.col("k").alias("of")).distinct()
    found = values.join(circular, F.col("k") == F.col("of"), "left").select("k", F.when(F.col("of").isNull(), F.col("value")).cast("int").alias("level"))
    return keys.join(found, "k")


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``(conv_id, call_id, turn, key, level, status, errors, message)`` for every call and for every result without one.

    ``calls(conv_id, call_id, turn, name, arguments, needs)`` with arguments as JSON text and needs as call_ids of the
    conversation; ``results(conv_id, call_id, turn, content)``. A conversation's calls in order of (key, level, turn, call_id) stand
    after what they need. Status is the first that holds of: ``orphan`` (a result without a call), ``circle`` (needs
    itself, directly or not), ``repeated`` (a call_id that an earlier turn of the conversation has), ``invalid`` (arguments against
    the schema, an unknown tool, a need that isn't there), ``open`` (no result), ``ok``. Of several results the earliest turn
    is linked, of equal turns the least content. Nulls: a call without conv_id, call_id or turn is ``invalid`` and linked to nothing; null
    arguments count as ``{}``; arguments that aren't JSON, hold a number beyond a double's range or half a surrogate pair, or lie over ``DEEPEST`` levels deep
    are invalid, null needs as none, null content as an empty one. Rows that repeat a call entirely count once.
    Empty tables give an empty result; other columns are ignored. Level is null in a circle.
    """
    base = calls.select(
        F.col("conv_id").cast("string").alias("conv"), "conv_id", F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"),
        F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"), F.coalesce("needs", F.array().cast("array<string>")).alias("needs"),
    ).distinct()
    base = base.withColumn("whole", F.expr("conv is not null and call_id is not null and turn is not null"))
    first = base.where("whole").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("f"))
    ids = checkpointed(first.select(F.struct("conv", "call_id").alias("k"), F.col("f.turn").alias("turn"), F.col("f.needs").alias("needs")))
    wanted = ids.select("k", F.explode("needs").alias("want")).where("want is not null").select("k", F.struct(F.col("k.conv").alias("conv"), F.col("want").alias("call_id")).alias("need")).distinct()
    there = wanted.join(ids.select(F.col("k").alias("need")), "need", "left_semi")
    absent = wanted.join(ids.select(F.col("k").alias("need")), "need", "left_anti").groupBy("k").agg(F.array_sort(F.collect_set("need.call_id")).alias("absent"))
    order = _ordered(ids, there)
    answers = results.where("conv_id is not null and call_id is not null").groupBy(F.col("conv_id").cast("string").alias("conv"), F.col("call_id").cast("string").alias("call_id")).agg(
        F.min(F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))).alias("answer"), F.first("conv_id").alias("of_conv")
    )
    rows = (
        base.withColumn("k", F.when(F.col("whole"), F.struct("conv", "call_id")))
        .join(first.select(F.struct("conv", "call_id").alias("k"), "f"), "k", "left")
        .join(order.select("k", "key", "level"), "k", "left").join(absent, "k", "left")
        .withColumn("repeated", F.col("whole") & ~F.col("f").eqNullSafe(F.struct("turn", "name", "arguments", "needs")))
        .drop("conv", "needs", "f").withColumn("call", F.lit(True))
    )
    linked = rows.join(answers.select(F.struct("conv", "call_id").alias("k"), "answer"), "k", "left").select(
        "conv_id", "call_id", "turn", "name", "arguments", "whole", "key", "level", "absent", "repeated", "call", F.col("answer.content").alias("content"), F.col("answer").isNotNull().alias("answered")
    )
    orphans = answers.withColumn("k", F.struct("conv", "call_id")).join(ids.select("k"), "k", "left_anti").select(
        F.col("of_conv").alias("conv_id"), "call_id", F.col("answer.turn").alias("turn"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(True).alias("whole"), F.col("answer.turn").alias("key"), F.lit(0).alias("level"), F.lit(None).cast("array<string>").alias("absent"), F.lit(False).alias("repeated"),
        F.lit(False).alias("call"), F.col("answer.content").alias("content"), F.lit(True).alias("answered"),
    )
    both = linked.unionByName(orphans)
    kept = ["conv_id", "call_id", "turn", "key", "level"]
    schema = both.select(*kept).schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                status, errors, messages = [], [], []
                for r in part.drop_columns(["conv_id"]).to_pylist():
                    value, found = _checked(r["name"], r["arguments"], schemas) if r["call"] else (None, [])
                    found += [f"needs {x}: not there" for x in r["absent"] or []]
                    if not r["whole"]:
                        found.append("no conversation, identifier or turn")
                    status.append(
                        "orphan" if not r["call"] else "circle" if r["whole"] and r["level"] is None else "repeated" if r["repeated"] else "invalid" if found else "ok" if r["answered"] else "open"
                    )
                    errors.append(found)
                    call = {"id": r["call_id"], "name": r["name"], "arguments": value} if r["call"] else None
                    result = {"id": r["call_id"], "content": r["content"]} if r["answered"] else None
                    messages.append(canonical({"call": call, "result": result}))
                columns = [*(part.column(k) for k in kept), pa.array(status, pa.string()), pa.array(errors, pa.list_(pa.string())), pa.array(messages, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "status", "errors", "message"])

    return both.mapInArrow(run, f"{schema}, status string, errors array<string>, message string")
