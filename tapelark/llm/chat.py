"""Chat formatting: tool calls linked to their results, checked and serialised.

A message's text may be JSON. An assistant's object with ``tool_calls`` holds calls (``id``, ``name``
and ``arguments``, these an object or JSON text, or both under ``function``) and perhaps ``content``; an
object with ``tool_call_id`` of role ``tool`` or ``function`` is a result. Anything else is a plain
message. Calls and results are hash-joined by conversation and identifier. A conversation's items are in
topological order when sorted by (order_turn, order_rank, turn, part): an item keeps its turn, but a
result stands behind its call. As each result depends on one call and calls on nothing, that key is
exact, and no conversation, however long, has to fit one task.

``status``: ``ok``; of calls ``duplicate_id`` (the first call of an id in a conversation is the one that
counts), ``unknown_tool``, ``bad_arguments: <where>``, ``unanswered``; of results ``orphan``.

Defined cases: null texts are plain messages with null content; a null id links with nothing; equal rows
are items of their own; broken JSON, and JSON nested deeper than ``DEEPEST``, is a plain message (as arguments
it stays text, which breaks the schema); lone surrogates that JSON escapes hide become U+FFFD; numbers have
any number of digits that the JSON reader takes. A schema with a keyword that is not known is refused.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelark.llm.common import materialize

DEEPEST = 100
_kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_lone = re.compile("[\ud800-\udfff]")
#: Keywords that say nothing about a value, and those that ``violation`` knows.
SILENT = frozenset("$schema $id $defs $comment definitions title description default examples deprecated readOnly writeOnly format".split())
KNOWN = frozenset(
    "type enum const properties required additionalProperties patternProperties propertyNames minProperties maxProperties items prefixItems contains minItems maxItems"
    " uniqueItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf anyOf allOf oneOf not $ref".split()
)


def canonical(value) -> str:
    """JSON with sorted keys, no spare space, whole numbers without a fraction; numbers that JSON lacks become null."""

    def plain(x):
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x.is_integer() and abs(x) < 1 << 53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return _lone.sub("\ufffd", json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def read(text: str):
    """The value of a JSON text; ValueError if it is broken or nested deeper than DEEPEST."""
    try:
        value = json.loads(text)
    except RecursionError as e:
        raise ValueError("too deep") from e
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > DEEPEST + 1:
            raise ValueError("too deep")
        level = [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x)]
    return value


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        if isinstance(value, bool) or not isinstance(value, int | float):
            return False
        return kind == "number" or isinstance(value, int) or value.is_integer()
    return isinstance(value, _kinds.get(kind, object))


def _same(a, b) -> bool:
    """JSON equality: numbers by value, booleans only with booleans."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _target(ref: str, root: dict):
    """What a local reference names."""
    if ref.partition("#")[0]:
        raise ValueError(f"only references within a schema are known, not {ref!r}")
    at = root
    for part in filter(None, ref[1:].split("/")):
        at = at[part.replace("~1", "/").replace("~0", "~")]
    return at


def check_schema(schema, root: dict | None = None, _seen: frozenset = frozenset()) -> None:
    """Raise ValueError if a schema has a keyword that ``violation`` does not know, so that nothing passes unchecked."""
    if isinstance(schema, bool):
        return
    root = schema if root is None else root
    if unknown := set(schema) - KNOWN - SILENT:
        raise ValueError(f"unknown keyword {min(unknown)!r}")
    ref = schema.get("$ref")
    if ref is not None and ref not in _seen:
        check_schema(_target(ref, root), root, _seen | {ref})
    one = [schema[k] for k in ("additionalProperties", "propertyNames", "items", "contains", "not") if k in schema]
    many = [x for k in ("anyOf", "allOf", "oneOf", "prefixItems") for x in schema.get(k, [])]
    for part in [*one, *many, *schema.get("properties", {}).values(), *schema.get("patternProperties", {}).values()]:
        check_schema(part, root, _seen)


def violation(value, schema, where: str = "$", root: dict | None = None) -> str | None:
    """Where a value first breaks a schema, null if nowhere."""
    if isinstance(schema, bool):
        return None if schema else where
    root = schema if root is None else root

    def breaks(x, part, at: str = where) -> str | None:
        return violation(x, part, at, root)

    if "$ref" in schema and (bad := breaks(value, _target(schema["$ref"], root))):
        return bad
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return where
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        return where
    for part in schema.get("allOf", []):
        if bad := breaks(value, part):
            return bad
    if "anyOf" in schema and all(breaks(value, s) for s in schema["anyOf"]):
        return where
    if "oneOf" in schema and sum(not breaks(value, s) for s in schema["oneOf"]) != 1:
        return where
    if "not" in schema and not breaks(value, schema["not"]):
        return where
    if isinstance(value, dict):
        return _object(value, schema, where, breaks)
    if isinstance(value, list):
        return _array(value, schema, where, breaks)
    if isinstance(value, str):
        fits = schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf)
        return None if fits and ("pattern" not in schema or re.search(schema["pattern"], value)) else where
    if _is(value, "number") and not _number(value, schema):
        return where
    return None


def _number(value, schema: dict) -> bool:
    inside = schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)
    inside = inside and not value <= schema.get("exclusiveMinimum", -math.inf) and not value >= schema.get("exclusiveMaximum", math.inf)
    step = schema.get("multipleOf")
    return inside and (step is None or math.isfinite(value) and (Fraction(str(value)) / Fraction(str(step))).denominator == 1)


def _object(value: dict, schema: dict, where: str, breaks) -> str | None:
    for name in schema.get("required", []):
        if name not in value:
            return f"{where}.{name}"
    if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf):
        return where
    known, shaped = schema.get("properties", {}), schema.get("patternProperties", {})
    for name in sorted(value):
        parts = [known[name]] if name in known else []
        parts += [part for shape, part in shaped.items() if re.search(shape, name)]
        for part in parts or [schema.get("additionalProperties", True)]:
            if bad := breaks(value[name], part, f"{where}.{name}"):
                return bad
        if "propertyNames" in schema and breaks(name, schema["propertyNames"]):
            return f"{where}.{name}"
    return None


def _array(value: list, schema: dict, where: str, breaks) -> str | None:
    if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
        return where
    first = schema.get("prefixItems", [])
    for k, x in enumerate(value):
        if bad := breaks(x, first[k] if k < len(first) else schema.get("items", True), f"{where}[{k}]"):
            return bad
    if "contains" in schema and all(breaks(x, schema["contains"]) for x in value):
        return where
    # Equal values have equal canonical texts.
    return where if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value) else None


def parsed(role: str | None, text: str | None) -> list[dict]:
    """The items of a message: kind, call_id, name, body (canonical JSON of arguments or content), and a call's arguments as ``value``."""

    def item(kind: str, content, call_id=None, name=None) -> dict:
        known = {"call_id": call_id, "name": name}
        return {"kind": kind, "body": canonical(content), "value": content} | {k: None if v is None else _lone.sub("\ufffd", v if isinstance(v, str) else canonical(v)) for k, v in known.items()}

    plain = [item("message", text)]
    if not text or text.lstrip()[:1] != "{":
        return plain
    try:
        value = read(text)
    except ValueError:
        return plain
    if role == "assistant" and isinstance(value.get("tool_calls"), list):
        out = [item("message", value["content"])] if value.get("content") else []
        for call in value["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            inner = call["function"] if isinstance(call.get("function"), dict) else call
            arguments = inner.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = read(arguments)
                except ValueError:
                    pass
            out.append(item("call", arguments, call.get("id"), inner.get("name")))
        return out or plain
    if role in ("tool", "function") and "tool_call_id" in value:
        return [item("result", value.get("content"), value["tool_call_id"])]
    return plain


ITEM = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("part", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("call_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("problem", T.StringType()),
])


def items(turns: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """A row per item of each message, with what is wrong with a call's tool or arguments."""
    for schema in tools.values():
        check_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for part, item in enumerate(parsed(role, text)):
                    problem, value = None, item.pop("value")
                    if item["kind"] == "call":
                        if item["name"] not in tools:
                            problem = "unknown_tool"
                        elif bad := violation(value, tools[item["name"]]):
                            problem = _lone.sub("\ufffd", f"bad_arguments: {bad}")
                    out.append({"conv_id": conv, "turn": turn, "role": role, "part": part, "problem": problem} | item)
            yield pa.RecordBatch.from_pylist(out, schema=_arrow)

    kinds = {T.LongType: pa.int64(), T.StringType: pa.string()}
    _arrow = pa.schema([(f.name, kinds[type(f.dataType)]) for f in ITEM])
    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    return turns.select(*cols).mapInArrow(run, ITEM)


def linked(turns: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, part, role, kind, call_id, name, call_turn, status, order_turn, order_rank, json) per item."""
    every = materialize(items(turns, tools), "items")
    first = (
        every.filter("kind = 'call' AND call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "part", "name")).alias("c"))
        .select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("c.turn").alias("_turn"), F.col("c.part").alias("_part"), F.col("c.name").alias("_name"))
    )
    answered = every.filter("kind = 'result' AND call_id IS NOT NULL").select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i")).distinct().withColumn("_answered", F.lit(True))
    known = first.join(answered, ["_c", "_i"], "left")
    # Plain messages have no identifier and pass by the join.
    tied = every.filter("kind <> 'message'").join(known.hint("shuffle_hash"), (F.col("conv_id") == F.col("_c")) & (F.col("call_id") == F.col("_i")), "left")
    calls = (
        F.when((F.col("turn") != F.col("_turn")) | (F.col("part") != F.col("_part")), "duplicate_id")
        .when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_answered").isNull(), "unanswered").otherwise("ok")
    )
    tied = tied.withColumn("status", F.when(F.col("kind") == "call", calls).otherwise(F.when(F.col("_turn").isNull(), "orphan").otherwise("ok")))
    result = F.col("kind") == "result"
    tied = tied.withColumn("name", F.when(result, F.col("_name")).otherwise(F.col("name"))).withColumn("call_turn", F.col("_turn"))
    plain = every.filter("kind = 'message'").withColumn("status", F.lit("ok")).withColumn("call_turn", F.lit(None).cast("long"))
    cols = ["conv_id", "turn", "part", "role", "kind", "call_id", "name", "call_turn", "status", "body"]
    out = plain.select(cols).unionByName(tied.select(cols))
    out = out.withColumn("order_turn", F.when(result, F.greatest("turn", "call_turn")).otherwise(F.col("turn"))).withColumn("order_rank", result.cast("int"))
    return serialised(out)


def serialised(rows: DataFrame) -> DataFrame:
    """``json``: each item as canonical JSON, its keys in order."""

    def text(name: str):
        # to_json escapes as JSON does; the value stands between {"v": and }.
        value = F.to_json(F.struct(F.col(name).alias("v")))
        return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.substring(value, F.lit(6), F.length(value) - 6))

    call = F.concat(F.lit('{"arguments":'), F.col("body"), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"role":'), text("role"), F.lit(',"type":"tool_call"}'))
    answer = F.concat(F.lit('{"content":'), F.col("body"), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"role":'), text("role"), F.lit(',"type":"tool_result"}'))
    plain = F.concat(F.lit('{"content":'), F.col("body"), F.lit(',"role":'), text("role"), F.lit("}"))
    return rows.withColumn("json", F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", answer).otherwise(plain)).drop("body")
