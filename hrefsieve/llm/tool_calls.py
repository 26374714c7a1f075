"""Chat formatting: tool calls linked with their results, ordered, validated, serialised."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefsieve.llm.tables import cut, scratch_path, small

_KINDS: dict[str, Callable[[Any], bool]] = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: (isinstance(x, int) and not isinstance(x, bool)) or (isinstance(x, float) and x.is_integer()),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict),
}


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema (type, enum, bounds, lengths, items, properties)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if _KINDS["number"](value):
        out += [f"{at}: below {schema['minimum']}"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{at}: above {schema['maximum']}"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, str | list):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength" if isinstance(value, str) else "minItems", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength" if isinstance(value, str) else "maxItems", math.inf) else []
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: lacks {k}" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                out += violations(x, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}: unknown {k}")
    return out


#: halves of characters that stand alone; UTF-8 has no form for them
_LONE = re.compile("[\ud800-\udfff]")


def _utf8(text: str) -> str:
    """Text that UTF-8 can hold: a lone half of a character is escaped, as JSON has it."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    """JSON without spaces, keys sorted, characters as they are, whole numbers without a fraction."""
    return _utf8(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _number(text: str) -> float | int:
    value = float(text)
    if math.isinf(value):
        raise ValueError("out of range")
    return int(value) if value.is_integer() and abs(value) < 1 << 53 else value


def _no_number(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def parsed(text: str | None) -> tuple[Any, list[str]]:
    """The value of a JSON text (null: null) and what is wrong with the text.

    What is no JSON stays a string: ``NaN`` and infinities, numbers beyond a double, and
    nesting too deep to be read. Of repeated keys the last counts and the first repeat is reported.
    """
    repeated: list[str] = []

    def merged(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            seen: set[str] = set()
            repeated.append(next(k for k, _ in pairs if k in seen or seen.add(k)))
        return out

    try:
        value = json.loads("null" if text is None else text, parse_float=_number, parse_constant=_no_number, object_pairs_hook=merged)
        return value, [f"$: repeated key {k}" for k in repeated[:1]]
    except ValueError:
        return text, ["$: not JSON"]
    except RecursionError:
        return text, ["$: nested too deep"]


def _serialised(schemas: dict[str, dict]) -> Callable:
    """A call and its result as one canonical JSON text, with what is wrong with the arguments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "call_id", "tool", "arguments", "result", "has_result", "level", "depends_on"]
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts, problems = [], []
                for _, _, call_id, tool, arguments, result, has_result, _, needs in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    value, wrong = parsed(arguments)
                    message = {"id": call_id, "tool": tool, "depends_on": sorted({x for x in needs or [] if x is not None})} | ({"result": result} if has_result else {})
                    try:
                        if not wrong:
                            wrong = violations(value, schemas[tool]) if tool in schemas else [f"$: unknown tool {tool}"]
                        texts.append(canonical(message | {"arguments": value}))
                    except RecursionError:  # what can be read may still be too deep to be written
                        wrong = ["$: nested too deep"]
                        texts.append(canonical(message | {"arguments": arguments}))
                    problems.append(_utf8("; ".join(wrong)) or None)
                kept = [batch.column(c) for c in ("conv_id", "turn", "call_id", "tool", "has_result", "level")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(problems, pa.string())], names=["conv_id", "turn", "call_id", "tool", "has_result", "level", "json", "problems"])

    return run


def ordered(calls: DataFrame) -> DataFrame:
    """(call key, level) of calls (conv_id, call_id, depends_on): 0 if a call needs no other
    call of its conversation, else one more than the highest level it needs.

    One frontier is settled at a time by joins over all conversations, so a conversation
    of any size is never gathered, and rows are read once when their last need is met. A
    level is a folder of one table: plans don't grow with depth, but a chain takes as many
    rounds as it is long.
    Calls in or behind a cycle have no level. Needs that no call of the conversation
    meets, and repeated ones, don't count.
    """
    nodes = cut(calls.select("conv_id", "call_id").distinct(), "nodes")
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("need")).where(F.col("need").isNotNull()).distinct()
    edges = edges.join(nodes.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi")
    edges = cut(edges, "needs")
    waiting = edges
    level = cut(nodes.join(small(edges).select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level")
    base, at = scratch_path(calls.sparkSession, "levels"), 0
    level.drop("level").write.parquet(f"{base}/level=0")
    while not waiting.isEmpty():
        met = small(level).select("conv_id", F.col("call_id").alias("need"))
        left = cut(waiting.join(met, ["conv_id", "need"], "left_anti"), "waiting")
        ready = waiting.select("conv_id", "call_id").distinct().join(small(left).select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        at += 1
        ready.write.parquet(f"{base}/level={at}")
        level = calls.sparkSession.read.schema(ready.schema).parquet(f"{base}/level={at}")
        if level.isEmpty():
            break
        waiting = left
    return calls.sparkSession.read.schema(T.StructType([*nodes.schema.fields, T.StructField("level", T.IntegerType())])).parquet(base)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: its place in its conversation, status and canonical JSON.

    ``calls``: conv_id, turn, call_id, tool, arguments (JSON), depends_on (call ids).
    ``results``: conv_id, call_id, result. Joined by conversation and id; of repeated
    calls the first turn counts (then the smallest arguments), of repeated results the
    smallest. Within a conversation calls are in order of level, turn and id; calls in
    cycles come without level. Arguments that are no JSON (``parsed``) stay a string and
    make a call invalid, however long or deep they are. Calls without conversation or id are left out; results
    without a call are counted nowhere. Empty tables give no rows; other columns are not
    read. Returns conv_id, turn, call_id, tool, level, status, problems and json, where
    status is ok, no_result, invalid or cycle.
    """
    key = ["conv_id", "call_id"]
    first = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "tool", "arguments", "depends_on")).alias("c"))
    calls = cut(first.select(*key, "c.*"), "calls")
    results = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min("result").alias("result"), F.lit(True).alias("has_result"))
    levels = cut(ordered(calls), "levels")
    rows = calls.join(results, key, "left").join(levels, key, "left").withColumn("has_result", F.coalesce("has_result", F.lit(False)))
    schema = "conv_id long, turn long, call_id string, tool string, has_result boolean, level int, json string, problems string"
    done = rows.select("conv_id", "turn", "call_id", "tool", "arguments", "result", "has_result", "level", "depends_on").mapInArrow(_serialised(schemas), schema)
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("problems").isNotNull(), "invalid").when(~F.col("has_result"), "no_result").otherwise("ok")
    return done.select("conv_id", "turn", "call_id", "tool", "level", status.alias("status"), "problems", "json")


#: tools of the calls that ``from_conversations`` derives
SCHEMAS = {
    "lookup": {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}},
    },
    "rewrite": {
        "type": "object", "required": ["text", "style"],
        "properties": {"text": {"type": "string", "maxLength": 400}, "style": {"enum": ["plain", "short"]}},
    },
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations stand for: a user's turn asks, the assistant's
    next turn answers. Turns of an even number of words look something up, others have a
    text rewritten. A call needs the one that half its turn number points to."""
    rows = turns.where("conv_id is not null and turn is not null")
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    words = F.size(F.array_remove(F.split(text, " "), ""))
    lookup = F.to_json(F.struct(words.alias("limit"), text.alias("query")))
    style = F.when(words % 3 == 0, "plain").when(words % 3 == 1, "short").otherwise("loud")
    rewrite = F.to_json(F.struct(style.alias("style"), text.alias("text")))
    even = words % 2 == 0
    need = (F.floor(turn / 4) * 2).cast("long")
    calls = rows.where("role = 'user'").select(
        "conv_id", "turn", name(turn).alias("call_id"), F.when(even, "lookup").otherwise("rewrite").alias("tool"),
        F.when(even, lookup).otherwise(rewrite).alias("arguments"), F.when(need < turn, F.array(name(need))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = rows.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), text.alias("result"))
    return calls, results
