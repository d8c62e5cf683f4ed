"""Chat formatting with tool-call linking.

A message's text may hold blocks <tool_call>{"id", "name", "arguments", "after"?}</tool_call> and
<tool_result>{"id", "content"}</tool_result>. Each block, and the text around the blocks, becomes an item. Calls and results
are linked by a hash join on conversation and identifier. Calls depend on the calls named in "after" and on those whose
results their arguments use as {"$result": id}. Levels come from the connected components of the dependencies: a component of
up to WHOLE of them is put in order by one task, a larger one by rounds in which calls whose dependencies all
have a level get theirs. So (conv_id, level, turn, seq) is a topological order, and what stays without a level is in or behind
a cycle. Arguments are validated against SCHEMAS, and every item is serialised as canonical JSON: sorted keys, no
spaces, UTF-8. NaN and infinities are no JSON, and lone surrogates no UTF-8: such a block is malformed, and kept as its text.

Items are never gathered by conversation: a conversation of any length is spread over the cluster.

Defined results: null text is an item with content null; an empty text, an empty one. A block that isn't a JSON object with
the keys asked for has status malformed. Of several calls (or results) of one identifier the first by (turn, seq) is linked
and the others have status duplicate; of rows with the same conv_id, turn and seq the first by body is. A result before its call has status early. Null conv_id, turn or role are kept;
calls of a null conversation are linked with nothing. Repeated rows give repeated items. Very long texts are read whole, a
message at a time. Extra columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.components import components
from twinsift.llm.shared import cut, parts

NAME = "op3_tool_call_linking"
SQL = None

#: Dependencies of a component that one task puts in order, and MB of a task's dependencies.
WHOLE, TASK_MB = 1_000_000, 32

#: Tool name: parameter: (JSON types, required). Tools without an entry have status unknown_tool.
SCHEMAS = {
    "search": {"query": (("string",), True), "limit": (("integer",), False)},
    "fetch": {"url": (("string",), True)},
    "calculate": {"expression": (("string",), True), "digits": (("integer",), False)},
    "store": {"key": (("string",), True), "value": (("string", "number", "integer", "boolean", "object", "array", "null"), True)},
}

_BLOCK = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
_ITEM = "conv_id long, turn long, seq int, role string, kind string, id string, name string, errors array<string>, deps array<string>, body string"


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def _kind(value) -> str:
    if value is None:
        return "null"
    for kind, types in (("boolean", bool), ("integer", int), ("number", float), ("string", str), ("array", list), ("object", dict)):
        if isinstance(value, types):
            return kind
    return "object"


def uses(value) -> list[str]:
    """Identifiers named by {"$result": id} anywhere in a value."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {"$result"} and isinstance(v["$result"], str):
                out.append(v["$result"])
            else:
                todo += v.values()
        elif isinstance(v, list):
            todo += v
    return out


def invalid(name: str, arguments, schemas=SCHEMAS) -> list[str]:
    """What is wrong with a call's arguments, in order of the parameters' names."""
    if name not in schemas:
        return ["unknown_tool"]
    if not isinstance(arguments, dict):
        return ["arguments"]
    schema, out = schemas[name], []
    for p in sorted({*schema, *arguments}):
        if p not in schema:
            out.append(f"unexpected:{p}")
        elif p not in arguments:
            if schema[p][1]:
                out.append(f"missing:{p}")
        elif not (isinstance(arguments[p], dict) and set(arguments[p]) == {"$result"}):
            kind = _kind(arguments[p])
            if kind not in schema[p][0] and not (kind == "integer" and "number" in schema[p][0]):
                out.append(f"type:{p}")
    return out


def _object(raw: str, keys: set[str]):
    try:
        got = json.loads(raw, parse_constant=_no_number)
        # an overflowing number, or a surrogate by its escape, can't be written again
        canonical(got).encode()
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) and keys <= set(got) and isinstance(got["id"], str) else None


def items_of(role, text, schemas=SCHEMAS):
    """(kind, id, name, errors, deps, body) of each item of a message."""
    if text is None:
        yield "text", None, None, [], [], canonical({"content": None, "role": role})
        return
    at = n = 0
    for m in _BLOCK.finditer(text):
        if text[at : m.start()].strip():
            n += 1
            yield "text", None, None, [], [], canonical({"content": text[at : m.start()], "role": role})
        at, n = m.end(), n + 1
        if m[1] == "call":
            got = _object(m[2], {"id", "name", "arguments"})
            if got is None or not isinstance(got["name"], str):
                yield "call", None, None, ["malformed"], [], canonical({"content": m[2], "role": role})
                continue
            after = got.get("after", [])
            deps = sorted({x for x in after if isinstance(x, str)} | set(uses(got["arguments"]))) if isinstance(after, list) else sorted(set(uses(got["arguments"])))
            body = {"role": role, "tool_call": {"arguments": got["arguments"], "id": got["id"], "name": got["name"]}}
            yield "call", got["id"], got["name"], invalid(got["name"], got["arguments"], schemas), deps, canonical(body)
        else:
            got = _object(m[2], {"id", "content"})
            if got is None:
                yield "result", None, None, ["malformed"], [], canonical({"content": m[2], "role": role})
            else:
                yield "result", got["id"], None, [], [], canonical({"role": role, "tool_result": {"content": got["content"], "id": got["id"]}})
    if not n or text[at:].strip():
        yield "text", None, None, [], [], canonical({"content": text[at:], "role": role})


_NAMES = [x.split(" ")[0] for x in _ITEM.split(", ")]
_ARROW = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())


def items(conversations: DataFrame, schemas=SCHEMAS) -> DataFrame:
    def run(frames):
        for f in frames:
            out = []
            for c, t, role, text in zip(*(f.column(n) for n in ("conv_id", "turn", "role", "text")), strict=True):
                c, t, role, text = (x.as_py() for x in (c, t, role, text))
                out += [(c, t, k, role, *item) for k, item in enumerate(items_of(role, text, schemas))]
            cols = zip(*out, strict=True) if out else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _ARROW, strict=True)], _NAMES)

    some = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return some.mapInArrow(run, _ITEM)


def _ordered(table: pa.Table) -> pa.Table:
    """Levels of the calls of whole components, by taking away calls without open dependencies."""
    needs: dict[tuple, set] = {}
    users: dict[tuple, list] = {}
    for c, i, d in zip(*(table.column(n).to_pylist() for n in ("conv_id", "id", "dep")), strict=True):
        if (c, d) not in needs.setdefault((c, i), set()):
            needs[c, i].add((c, d))
            users.setdefault((c, d), []).append((c, i))
    level: dict[tuple, int] = {}
    now, n = [x for x in users if x not in needs], 0
    while now:
        level.update(dict.fromkeys(now, n))
        after = []
        for x in now:
            for u in users.get(x, ()):
                needs[u].discard(x)
                if not needs[u]:
                    after.append(u)
        now, n = after, n + 1
    rows = [(c, i, n) for (c, i), n in level.items()]
    cols = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("conv_id", "id", "level"), cols, (pa.int64(), pa.string(), pa.int32()), strict=True)})


def _by_rounds(edges: DataFrame) -> DataFrame:
    """Levels of the calls of edges, one level a round."""
    use, need = edges.select("conv_id", "id"), edges.select("conv_id", F.col("dep").alias("id"))
    done, open_ = cut(need.join(use, ["conv_id", "id"], "left_anti").distinct().withColumn("level", F.lit(0))), edges
    while True:
        # a call is ready when each of its dependencies has a level
        known = open_.join(done.select("conv_id", F.col("id").alias("dep"), "level"), ["conv_id", "dep"], "left")
        ready = known.groupBy("conv_id", "id").agg(F.max("level").alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all")).where("all")
        ready = cut(ready.select("conv_id", "id", (F.col("level") + 1).alias("level")))
        if ready.isEmpty():
            return done
        done, open_ = cut(done.unionAll(ready)), cut(open_.join(ready, ["conv_id", "id"], "left_anti"))


def levels(calls: DataFrame, whole: int | None = None) -> DataFrame:
    """conv_id, id, level of each call (conv_id, id, deps) that is in no cycle and behind none. Level 0 depends on nothing;
    dependencies that name no call don't count. whole: WHOLE, if None."""
    whole = WHOLE if whole is None else whole
    nodes = calls.select("conv_id", "id")
    edges = calls.select("conv_id", "id", F.explode("deps").alias("dep")).join(nodes.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"])
    edges = cut(edges.select("conv_id", "id", "dep"))
    ends = edges.select("conv_id", "id").unionAll(edges.select("conv_id", F.col("dep").alias("id"))).distinct()
    done = nodes.join(ends, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0))
    if edges.isEmpty():
        return done
    name = lambda c: F.concat_ws(":", F.col("conv_id").cast("string"), F.col(c))
    found = components(edges.select(name("id").alias("a"), name("dep").alias("b")))
    # a call that depends on itself alone is a component too
    of = edges.withColumn("node", name("id")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = of.groupBy("component").agg(F.count("*").alias("n"))
    of = cut(of.join(size, "component").select("conv_id", "id", "dep", "component", "n"))
    # components are dealt to groups by the task's share, and stay whole
    groups = parts(of.count() * 100, TASK_MB)
    small = of.where(F.col("n") <= whole).select("conv_id", "id", "dep", F.pmod(F.xxhash64("component"), F.lit(groups)).alias("g"))
    done = done.unionAll(small.groupBy("g").applyInArrow(_ordered, "conv_id long, id string, level int"))
    large = of.where(F.col("n") > whole).select("conv_id", "id", "dep")
    return done if large.isEmpty() else done.unionAll(_by_rounds(large))


def link(conversations: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """conv_id, turn, seq, kind, id, name, level, status, errors, linked_turn, linked_seq and body of each item.

    status: text; for calls ok, invalid, unanswered, cycle, duplicate, malformed (the first that holds from the end); for
    results ok, orphan, early, duplicate, malformed.
    """
    all_ = cut(items(conversations, schemas))
    place = F.struct("turn", "seq")
    named = all_.where("id IS NOT NULL AND conv_id IS NOT NULL")

    def firsts(kind: str) -> DataFrame:
        return named.where(F.col("kind") == kind).groupBy("conv_id", "id").agg(F.min(place).alias("at"))

    called, given = firsts("call"), firsts("result")
    # the first call of an identifier; of several at its place, the first by body
    calls = named.where("kind = 'call'").groupBy("conv_id", "id").agg(F.min_by("deps", F.struct("turn", "seq", "body")).alias("deps"))
    depth = levels(calls)
    tie = called.withColumnRenamed("at", "call_at").join(given.withColumnRenamed("at", "result_at"), ["conv_id", "id"], "full").join(depth, ["conv_id", "id"], "left")
    tools = all_.where("kind <> 'text'").join(tie, ["conv_id", "id"], "left")
    is_call = F.col("kind") == "call"
    mine = F.when(is_call, F.col("call_at")).otherwise(F.col("result_at"))
    status = (
        F.when(F.array_contains("errors", "malformed"), "malformed")
        .when(F.col("conv_id").isNull(), F.when(is_call, "unanswered").otherwise("orphan"))
        .when(place != mine, "duplicate")
        .when(is_call & F.col("level").isNull(), "cycle")
        .when(is_call & F.col("result_at").isNull(), "unanswered")
        .when(is_call & (F.size("errors") > 0), "invalid")
        .when(~is_call & F.col("call_at").isNull(), "orphan")
        .when(~is_call & (F.col("call_at") > F.col("result_at")), "early")
        .otherwise("ok")
    )
    other = F.when(is_call, F.col("result_at")).otherwise(F.col("call_at"))
    level = F.when(is_call, 2 * F.col("level")).otherwise(2 * F.col("level") + 1)
    tools = tools.select("conv_id", "turn", "seq", "kind", "id", "name", level.alias("level"), status.alias("status"), "errors", other["turn"].alias("linked_turn"), other["seq"].alias("linked_seq"), "body")
    none = F.lit(None)
    plain = all_.where("kind = 'text'").select("conv_id", "turn", "seq", "kind", "id", "name", none.cast("int").alias("level"), F.lit("text").alias("status"), "errors", none.cast("long").alias("linked_turn"), none.cast("int").alias("linked_seq"), "body")
    return tools.unionAll(plain)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("errors", F.concat_ws(",", "errors"))


def _planted(conversations: DataFrame) -> DataFrame:
    """Every message with a call (even turns), or the result of the turn before (odd turns), after its text. A call comes after the
    call two turns before; some lack an argument, some have one too many, some results are missing, some calls name each other."""
    t, c = F.col("turn"), F.col("conv_id")
    s = lambda x: x.cast("string")
    after = F.when((c % 7 == 0) & (t == 0), F.lit('"c2"')).otherwise(F.concat(F.lit('"c'), s(t - 2), F.lit('"')))
    arguments = F.when((c + t) % 5 == 0, F.lit('"limit":3')).when((c + t) % 5 == 1, F.concat(F.lit('"query": "q", "more":'), s(t))).otherwise(F.concat(F.lit('"query":"q'), s(c), F.lit('"')))
    call = F.concat(F.lit('<tool_call>{"name": "search", "id":"c'), s(t), F.lit('","arguments":{'), arguments, F.lit('},"after":['), after, F.lit("]}</tool_call>"))
    result = F.when((c + t) % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('<tool_result>{"id":"c'), s(t - 1), F.lit('","content":['), s(c), F.lit(",null]}</tool_result>")))
    return conversations.select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.when(t % 2 == 0, call).otherwise(result)).alias("text"))


def planted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link() where the table's messages have calls and results."""
    return link(_planted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumn("errors", F.concat_ws(",", "errors"))


PLANTED_SQL = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 5 AS k, (conv_id + turn) % 3 AS j FROM conversations),
says AS (SELECT *, regexp_matches(text, '[^ \t\n\x0b\x0c\r]') AS said FROM m),
call AS (SELECT conv_id, turn, role, CASE WHEN said THEN 1 ELSE 0 END AS seq, 'c' || turn AS id, CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN 'c2' ELSE 'c' || (turn - 2) END AS dep,
  CASE k WHEN 0 THEN 'missing:query' WHEN 1 THEN 'unexpected:more' ELSE '' END AS errors,
  CASE k WHEN 0 THEN '{"limit":3}' WHEN 1 THEN '{"more":' || turn || ',"query":"q"}' ELSE '{"query":"q' || conv_id || '"}' END AS arguments FROM says WHERE turn % 2 = 0),
result AS (SELECT conv_id, turn, role, CASE WHEN said THEN 1 ELSE 0 END AS seq, 'c' || (turn - 1) AS id FROM says WHERE turn % 2 = 1 AND j <> 0),
known AS (SELECT a.conv_id, a.id, b.id AS dep FROM call a LEFT JOIN call b ON b.conv_id = a.conv_id AND b.id = a.dep),
level AS (SELECT conv_id, id, 0 AS level FROM known WHERE dep IS NULL UNION ALL SELECT known.conv_id, known.id, level + 1 FROM level JOIN known ON known.conv_id = level.conv_id AND known.dep = level.id),
calls AS (SELECT c.conv_id, c.turn, c.seq, 'call' AS kind, c.id, 'search' AS name, 2 * level AS level,
  CASE WHEN level IS NULL THEN 'cycle' WHEN r.turn IS NULL THEN 'unanswered' WHEN errors <> '' THEN 'invalid' ELSE 'ok' END AS status, errors, r.turn AS linked_turn, r.seq AS linked_seq,
  '{"role":' || coalesce(to_json(c.role)::VARCHAR, 'null') || ',"tool_call":{"arguments":' || arguments || ',"id":"' || c.id || '","name":"search"}}' AS body
  FROM call c LEFT JOIN level USING (conv_id, id) LEFT JOIN result r ON r.conv_id = c.conv_id AND r.id = c.id),
results AS (SELECT r.conv_id, r.turn, r.seq, 'result' AS kind, r.id, NULL AS name, 2 * level + 1 AS level, CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'ok' END AS status, '' AS errors, c.turn AS linked_turn, c.seq AS linked_seq,
  '{"role":' || coalesce(to_json(r.role)::VARCHAR, 'null') || ',"tool_result":{"content":[' || r.conv_id || ',null],"id":"' || r.id || '"}}' AS body
  FROM result r LEFT JOIN call c ON c.conv_id = r.conv_id AND c.id = r.id LEFT JOIN level ON level.conv_id = r.conv_id AND level.id = r.id),
plain AS (SELECT conv_id, turn, 0 AS seq, 'text' AS kind, NULL AS id, NULL AS name, NULL::INTEGER AS level, 'text' AS status, '' AS errors, NULL::BIGINT AS linked_turn, NULL::INTEGER AS linked_seq,
  '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS body FROM says WHERE said OR (turn % 2 = 1 AND j = 0))
SELECT conv_id, turn, seq::INTEGER AS seq, kind, id, name, level::INTEGER AS level, status, errors, linked_turn, linked_seq::INTEGER AS linked_seq, body FROM (SELECT * FROM calls UNION ALL SELECT * FROM results UNION ALL SELECT * FROM plain)
"""
