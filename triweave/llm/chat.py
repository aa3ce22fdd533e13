"""Operator 10, chat formatting with tool-call linking.

A turn's text may hold ``<tool_call>{"id": .., "name": .., "arguments": {..}}</tool_call>`` blocks, and
``<tool_result id="..">..</tool_result>`` blocks (in a turn of role ``tool``, a bare JSON object with
``tool_call_id`` and ``content`` is one too).  Calls and results are hash-joined by conversation and
identifier; a result stands after its call and a call after the results that its arguments name as
``{"$ref": id}``.  Arguments are validated against the tools' schemas, and each message is serialised as
canonical JSON: keys in code-point order, no spaces, UTF-8, whole numbers without a fraction.

Order: messages stand in order of conv_id, level, step, turn, part.  A message's level is its turn and its
step 0, unless something that it needs comes later: then it has the level of what it needs and a step more,
the latest of all that it needs.  Levels follow from joins on (conv_id, id), repeated while calls move.  A
call on a cycle of references, or with one that names no call with a result, is marked ``unresolved``; it
still follows what it needs outside the cycle.  ``depth`` and ``sub`` tell turns only: a result before its
call's turn has that turn and sub 1.  Messages are rows (conv_id, turn, part, kind, depth, sub, level,
step, status, json), so no conversation is collected in a task, however long it is.

Defined results: null texts are empty messages; null roles become ``unknown``; null conv_ids and turns are
kept, and their calls are linked within the null conversation; equal rows are one message; of calls with
one identifier the earliest turn counts, the others are ``duplicate``; of results likewise; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.plans.scratch import Scratch

BLOCK = re.compile(r'<tool_call>(.*?)</tool_call>|<tool_result id="([^"]*)">(.*?)</tool_result>', re.S)
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}, "headers": {"type": "object"}}, "additionalProperties": False},
}
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
PART_SCHEMA = "conv_id long, turn long, part int, kind string, id string, name string, body string, refs array<string>, error string"


def canonical(value) -> str:
    """Canonical JSON of parsed JSON: floats without a fraction become whole numbers, NaN and infinities are refused."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53 else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def schema_error(value, schema: dict, path: str = "$") -> str | None:
    """The first way in which a value breaks a schema of the JSON Schema subset used here; references pass any type."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return None
    kind = schema.get("type")
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or (kind == "integer" and value != int(value)):
            return f"{path}: not of type {kind}"
    elif kind and not isinstance(value, TYPES[kind]):
        return f"{path}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not an allowed value"
    if "minimum" in schema and value < schema["minimum"]:
        return f"{path}: below {schema['minimum']}"
    if "maximum" in schema and value > schema["maximum"]:
        return f"{path}: above {schema['maximum']}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                return f"{path}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if error := schema_error(value[k], known[k], f"{path}.{k}"):
                    return error
            elif schema.get("additionalProperties") is False:
                return f"{path}.{k}: not known"
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            if error := schema_error(v, schema["items"], f"{path}[{i}]"):
                return error
    return None


def references(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"}:
            return [str(value["$ref"])]
        return [r for k in sorted(value) for r in references(value[k])]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _load(text: str):
    return json.loads(text, parse_constant=_no_constant)


def parse_turn(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(kind, id, name, body, refs, error) of the parts of a turn: text, calls and results."""
    text, role, parts, at = text or "", role or "unknown", [], 0
    if role == "tool" and text.lstrip()[:1] == "{":
        try:
            value = _load(text)
            if "tool_call_id" in value:
                return [("result", str(value["tool_call_id"]), None, canonical(value.get("content")), [], None)]
        except (ValueError, RecursionError):
            pass
    for m in BLOCK.finditer(text):
        if before := text[at : m.start()].strip():
            parts.append(("text", None, role, before, [], None))
        at = m.end()
        if m[2] is not None:
            parts.append(("result", m[2], None, canonical(m[3]), [], None))
            continue
        try:
            call = _load(m[1])
            arguments = call.get("arguments", {})
            name, body = str(call["name"]), canonical(arguments)
            error = schema_error(arguments, schemas[name]) if name in schemas else f"{name}: no such tool"
            parts.append(("call", str(call["id"]), name, body, references(arguments), error))
        except (ValueError, KeyError, AttributeError, TypeError, OverflowError, RecursionError):
            parts.append(("text", None, role, m[0], [], "not a tool call"))
    if (rest := text[at:].strip()) or not parts:
        parts.append(("text", None, role, rest, [], None))
    return parts


def _parts(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        names = [x.split()[0] for x in PART_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for conv_id, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                rows += [(conv_id, turn, i, *p) for i, p in enumerate(parse_turn(role, text, schemas))]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for kind, id_, name, body, status, result in zip(*(batch.column(c).to_pylist() for c in ("kind", "id", "name", "body", "status", "result")), strict=True):
            if kind == "text":
                message = {"content": body, "role": name}
            elif kind == "call":
                message = {"role": "assistant", "tool_call": {"arguments": _load(body), "id": id_, "name": name}}
            else:
                message = {"content": _load(body), "role": "tool", "tool_call_id": id_}
            if status != "ok":
                message["status"] = status
            if kind == "call":
                message["answered"] = result
            out.append(canonical(message))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "part", "kind", "depth", "sub", "level", "step", "status")), pa.array(out, pa.string())], names=["conv_id", "turn", "part", "kind", "depth", "sub", "level", "step", "status", "json"])


def _behind(last, own):
    """(level, step, t, part): the place of what stands at ``own`` by itself and needs what is at ``last``."""
    return F.when(last >= own, F.struct(last["level"].alias("level"), (last["step"] + 1).alias("step"), own["t"].alias("t"), own["part"].alias("part"))).otherwise(own)


def _place(at):
    return F.struct(at["t"].alias("level"), F.lit(0).alias("step"), at["t"].alias("t"), at["part"].alias("part"))


def _farthest(links: DataFrame, s: Scratch) -> DataFrame:
    """(conv, id, far): the greatest id from which (conv, a, b) links lead to each id, or its own."""
    far = s.table(links.select("conv", F.col("a").alias("id")).union(links.select("conv", "b")).distinct().withColumn("far", F.col("id")))
    fresh = far
    while not fresh.isEmpty():
        sent = links.join(fresh.withColumnRenamed("id", "a"), ["conv", "a"]).groupBy("conv", F.col("b").alias("id")).agg(F.max("far").alias("new"))
        now = s.table(far.join(sent, ["conv", "id"], "left").select("conv", "id", F.greatest("far", "new").alias("far"), (F.col("new") > F.col("far")).alias("moved")))
        far, fresh = now.drop("moved"), now.where("moved").drop("moved")
    return far


def _cycles(links: DataFrame, s: Scratch) -> DataFrame:
    """The (conv, a, b) links within cycles: at the end, both ends of each are led to by, and lead to, the same greatest ids."""
    count = links.count()
    while count:
        for way in (("a", "b"), ("b", "a")):
            far = _farthest(links.select("conv", F.col(way[0]).alias("a"), F.col(way[1]).alias("b")), s)
            x, y = (far.select("conv", F.col("id").alias(c), F.col("far").alias(f"far_{c}")) for c in ("a", "b"))
            links = s.table(links.join(x, ["conv", "a"]).join(y, ["conv", "b"]).where("far_a = far_b").select("conv", "a", "b"))
        before, count = count, links.count()
        if count == before:
            break
    return links


def call_places(named: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, id, at, place) of the calls that move, and (conv, id) of those on cycles, from (conv, id, at,
    first, ref, call_at, result_at) of references that name a call with a result; ``first`` tells the call
    that counts of an identifier.  ``conv`` is not null."""
    nowhere = named.where("false").select("conv", "id")
    if named.isEmpty():
        return named.where("false").select("conv", "id", "at", _place(F.col("at")).alias("place")), nowhere
    back = named.where("first AND call_at >= at").select("conv").distinct()  # a cycle has a link back
    links = s.table(named.where("first").join(back, "conv", "left_semi").select("conv", F.col("ref").alias("a"), F.col("id").alias("b")).distinct())
    ring = _cycles(links, s)
    bad = s.table(ring.select("conv", F.col("b").alias("id")).distinct())
    cut = ring.select("conv", F.col("a").alias("ref"), F.col("b").alias("id"), F.lit(True).alias("first"))
    free = s.table(named.join(cut, ["conv", "ref", "id", "first"], "left_anti"))
    # what moves is joined with the calls that name it, until nothing moves
    calls = free.select("conv", "ref", "id", "at", "first", "result_at", _place(F.col("call_at")).alias("from"))
    places = None
    while True:
        last = _behind(F.col("from"), _place(F.col("result_at")))
        new = calls.groupBy("conv", "id", "at", "first").agg(F.max(last).alias("last"))
        own = _place(F.col("at"))
        new = new.where(F.col("last") >= own).select("conv", "id", "at", "first", _behind(F.col("last"), own).alias("place"))
        if places is None:
            places = fresh = s.table(new)
        else:
            both = places.withColumnRenamed("place", "old").join(new, ["conv", "id", "at", "first"], "full")
            now = s.table(both.select("conv", "id", "at", "first", F.greatest("old", "place").alias("place"), (F.col("old").isNull() | (F.col("place") > F.col("old"))).alias("moved")))
            places, fresh = now.drop("moved"), now.where("moved").drop("moved")
        if fresh.isEmpty():
            return places.select("conv", "id", "at", "place"), bad
        sent = fresh.where("first").select("conv", F.col("id").alias("ref"), F.col("place").alias("from"))
        calls = free.join(sent, ["conv", "ref"]).select("conv", "ref", "id", "at", "first", "result_at", "from")


def chat_messages(turns: DataFrame, scratch: Scratch, schemas: dict | None = None) -> DataFrame:
    """(conv_id, turn, part, kind, depth, sub, level, step, status, json) of every message; in order of
    conv_id, level, step, turn, part.

    ``sub`` is 0 for what stays in its turn; results that moved to their call's turn have 1.
    """
    schemas = SCHEMAS if schemas is None else schemas
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    parts = scratch.table(rows.mapInArrow(_parts(schemas), PART_SCHEMA))
    at = F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), "part", "body")
    linked = parts.where("kind <> 'text'").withColumn("at", at)
    # the first call and the first result of an identifier; sums before the shuffle, so no conversation is gathered
    heads = linked.groupBy("conv_id", "id").agg(
        F.min(F.when(F.col("kind") == "call", F.col("at"))).alias("call_at"),
        F.min(F.when(F.col("kind") == "result", F.col("at"))).alias("result_at"),
    )
    heads = scratch.table(heads)
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    joined = linked.alias("p").join(heads.alias("h"), same("p", "h") & (F.col("p.id") == F.col("h.id"))).select("p.*", "h.call_at", "h.result_at")
    # references that name a call with a result order the calls; others and cycles are unresolved
    named = joined.where("kind = 'call'").select("conv_id", "id", "at", "call_at", F.explode("refs").alias("ref"))
    targets = heads.select("conv_id", "id", "call_at", "result_at")
    met = named.alias("n").join(targets.alias("t"), same("n", "t") & (F.col("n.ref") == F.col("t.id")), "left")
    conv = F.coalesce(F.col("n.conv_id").cast("string"), F.lit("")).alias("conv")
    met = scratch.table(met.select(conv, "n.id", "n.at", (F.col("n.at") == F.col("n.call_at")).alias("first"), "ref", "t.call_at", "t.result_at").distinct())
    missing = F.col("call_at").isNull() | F.col("result_at").isNull()
    places, ring = call_places(met.where(~missing), scratch)
    ring = met.where("first").join(ring, ["conv", "id"], "left_semi").select("conv", "id", "at")
    bad = met.where(missing).select("conv", "id", "at").union(ring).distinct().withColumn("unresolved", F.lit(True))
    moves = places.join(bad, ["conv", "id", "at"], "full")
    # a call has its own place; a result stands behind that of its call
    keyed = joined.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("of", F.when(F.col("kind") == "call", F.col("at")).otherwise(F.col("call_at")))
    told = keyed.join(moves.withColumnRenamed("at", "of"), ["conv", "id", "of"], "left")
    its = F.coalesce("place", _place(F.col("of")))
    told = told.withColumn("place", F.when((F.col("kind") == "result") & F.col("call_at").isNotNull(), _behind(its, _place(F.col("at")))).when(F.col("kind") == "call", its).otherwise(_place(F.col("at"))))
    status = (
        F.when((F.col("kind") == "call") & (F.col("at") > F.col("call_at")), "duplicate")
        .when((F.col("kind") == "result") & F.col("call_at").isNull(), "no call")
        .when((F.col("kind") == "result") & (F.col("at") > F.col("result_at")), "duplicate")
        .when(F.col("error").isNotNull(), F.concat(F.lit("invalid: "), F.col("error")))
        .when((F.col("kind") == "call") & F.col("unresolved"), "unresolved")
        .otherwise("ok")
    )
    moved = F.coalesce((F.col("kind") == "result") & (F.coalesce("turn", F.lit(-1)) < F.col("call_at.t")), F.lit(False))
    tools = told.select("conv_id", "turn", "part", "kind", "id", "name", "body", status.alias("status"), F.when(moved, F.col("call_at.t")).otherwise(F.coalesce("turn", F.lit(-1))).alias("depth"), moved.cast("int").alias("sub"), F.col("place.level").alias("level"), F.col("place.step").alias("step"), F.col("result_at").isNotNull().alias("result"))
    texts = parts.where("kind = 'text'").select("conv_id", "turn", "part", "kind", "id", "name", "body", F.coalesce("error", F.lit("ok")).alias("status"), F.coalesce("turn", F.lit(-1)).alias("depth"), F.lit(0).alias("sub"), F.coalesce("turn", F.lit(-1)).alias("level"), F.lit(0).alias("step"), F.lit(False).alias("result"))
    schema = "conv_id long, turn long, part int, kind string, depth long, sub int, level long, step int, status string, json string"
    return texts.unionByName(tools).mapInArrow(_serialise, schema)


def chat_digest(turns: DataFrame) -> DataFrame:
    """Every message of every conversation."""
    with Scratch(turns.sparkSession, "chat") as s:
        return s.keep(chat_messages(turns, s))
