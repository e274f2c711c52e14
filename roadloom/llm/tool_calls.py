"""Tool calls of conversations: link calls and results, order them, validate arguments, write canonical JSON."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from roadloom.llm.common import bound_batches
from roadloom.operators.graph import split_join
from roadloom.session import checkpointed

#: A conversation with at most so many calls is ordered within one task, a longer one by joins over all its calls.
LOCAL_CALLS = 10_000
#: Dependencies of a call up to which it is used to leave out dependencies that others imply.
FEW_DEPS = 8

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def parse_arguments(raw: str):
    """The value of a JSON text; ValueError for anything that canonical JSON cannot carry: numbers that are not finite,
    written so or by an exponent, and lone surrogates."""

    def number(x: str) -> float:
        value = float(x)
        if not math.isfinite(value):
            raise ValueError(x)
        return value

    value = json.loads(raw, parse_float=number, parse_constant=number)
    canonical(value).encode("utf-8")  # a lone surrogate has no bytes
    return value


def canonical(value) -> str:
    """JSON with sorted keys, no white space and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def argument_errors(arguments, schema: Mapping | None) -> list[str]:
    """What is wrong with parsed arguments under a schema of ``properties``, ``required`` and closed names."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["not an object"]
    found = [f"missing {k}" for k in sorted(schema.get("required", ())) if k not in arguments]
    for key in sorted(arguments):
        rule = schema.get("properties", {}).get(key)
        value = arguments[key]
        if rule is None:
            found.append(f"unexpected {key}")
        elif not isinstance(value, _TYPES[rule["type"]]) or isinstance(value, bool) != (rule["type"] == "boolean"):
            found.append(f"{key} is not {rule['type']}")
        elif "enum" in rule and value not in rule["enum"]:
            found.append(f"{key} is none of its values")
        elif "minimum" in rule and value < rule["minimum"]:
            found.append(f"{key} is below {rule['minimum']}")
        elif "maximum" in rule and value > rule["maximum"]:
            found.append(f"{key} is above {rule['maximum']}")
    return found


def levels_of(ids: list[str], depends_on: list[list[str]]) -> list[int | None]:
    """The level of each call of one conversation: 0 without dependencies among ``ids``, else one above the highest of
    them; None on a cycle and after one."""
    known, waits, then = {}, {}, defaultdict(list)
    for call, deps in zip(ids, depends_on, strict=True):
        waits[call] = set(deps)
    for call, deps in waits.items():
        waits[call] = deps & waits.keys()
        for d in waits[call]:
            then[d].append(call)
    open_ = {call: len(deps) for call, deps in waits.items()}
    ready = [call for call, n in open_.items() if n == 0]
    known = dict.fromkeys(ready, 0)
    for call in ready:  # grows while it is read
        for after in then[call]:
            known[after] = max(known.get(after, 0), known[call] + 1)
            open_[after] -= 1
            if open_[after] == 0:
                ready.append(after)
    settled = set(ready)
    return [known[call] if call in settled else None for call in ids]


def local_levels(calls: DataFrame) -> DataFrame:
    """(id, level) of calls (conv, id, on) whose conversations are short and hold all their dependencies."""

    @arrow_udf("array<long>")
    def levels(own: pa.Array) -> pa.Array:
        return pa.array([levels_of([c["id"] for c in conv], [c["on"] or [] for c in conv]) for conv in own.to_pylist()], pa.list_(pa.int64()))

    lists = calls.groupBy("conv").agg(F.collect_list(F.struct("id", "on")).alias("own"))
    each = F.explode(F.arrays_zip(F.col("own.id").alias("id"), levels("own").alias("level"))).alias("z")
    return lists.select(each).select("z.id", "z.level").where("level is not null")


def call_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``_levels``, on fewer edges: a dependency that another dependency of the same call has itself cannot set the level,
    and without such edges most branches become chains. Only calls with few dependencies are looked through, so a call
    that many depend on adds a handful of rows for each of them. If the levels do not fit all edges, which only a cycle
    among the dependencies of a call can cause, they are made anew from all of them."""
    few = edges.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") <= FEW_DEPS).select("id")
    beyond = edges.join(few, "id", "left_semi").select(F.col("id").alias("on"), F.col("on").alias("far"))
    via = edges.join(beyond, "on").where("id <> on and on <> far").select("id", F.col("far").alias("on"))
    found = checkpointed(_levels(calls, checkpointed(edges.join(via, ["id", "on"], "left_anti"))))
    low = found.select(F.col("id").alias("on"), F.col("level").alias("low"))
    wrong = edges.join(found, "id").join(low, "on", "left").where("low is null or low >= level")
    return found if wrong.isEmpty() else _levels(calls, edges)


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) for ids of ``calls`` (id): 0 without edges (id, on), else one above the highest that it depends on.

    Sorting by level is a topological order. Calls with one dependency form chains, and pointers along chains double
    with each round, so a chain of a million calls takes twenty rounds; only calls with several dependencies then need a
    round for each of their layers. Calls on a cycle, or after one, get no row.
    """
    degree = edges.groupBy("id").agg(F.count("*").alias("n"), F.min("on").alias("only"))
    nodes = checkpointed(calls.join(degree, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "only"))
    chain = checkpointed(nodes.where("n = 1").select("id", F.col("only").alias("up"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done")))
    total = chain.count()
    for _ in range(max(1, total.bit_length()) + 1):
        jump = chain.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = chain.where("not done").join(jump, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), (F.col("up2").isNull() | F.col("done2")).alias("done"))
        chain = checkpointed(chain.where("done").union(moved), instead_of=chain)
        if chain.where("not done").isEmpty():
            break
    ends = chain.where("done").select("id", "up", "dist")
    # Dependencies of branching calls, each as the end of its chain and the steps to it.
    branch = edges.join(nodes.where("n > 1").select("id"), "id").join(ends.select(F.col("id").alias("on"), "up", "dist"), "on", "left")
    cyclic = chain.where("not done").select(F.col("id").alias("on"))
    blocked = edges.join(nodes.where("n > 1").select("id"), "id").join(cyclic, "on", "left_semi").select("id").distinct()
    wait = checkpointed(branch.select("id", F.coalesce("up", "on").alias("on"), F.coalesce("dist", F.lit(0)).alias("dist")).join(blocked, "id", "left_anti"))
    known = checkpointed(nodes.where("n = 0").select("id", F.lit(0).cast("long").alias("level")))
    while True:
        tried = wait.join(known.withColumnRenamed("id", "on"), "on", "left").groupBy("id").agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.count(F.when(F.col("level").isNull(), 1)).alias("open"))
        ready = checkpointed(tried.where("open = 0").select("id", "level").join(known, "id", "left_anti"))
        if ready.isEmpty():
            break
        known = checkpointed(known.union(ready), instead_of=known)
    return known.union(ends.join(known.select(F.col("id").alias("up"), "level"), "up").select("id", (F.col("level") + F.col("dist")).alias("level")))


def _key(conv: Column, call: Column) -> Column:
    """One text for a pair of texts; null where the second is."""
    return F.concat(F.coalesce(F.length(conv).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(conv, F.lit("")), call)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], local_calls: int = LOCAL_CALLS, repeats: bool = False) -> DataFrame:
    """A row for each call id of ``calls`` (conv_id, call_id, name, arguments, depends_on) or of ``results``
    (call_id, content): conv_id, call_id, status, name, level, n_calls, n_results, missing_deps, valid, errors, json.

    Calls and results are hash-joined by call_id, and by conv_id and call_id if ``results`` has a conv_id too; then ids
    need to be unique in their conversation only, and dependencies are looked for there. status: ``linked``, ``pending``
    (no result), ``orphan`` (no call) or ``no_id`` (the row's id is null; each such row stands for itself). Of several
    calls or results with an id the smallest stands, and the counts tell; with ``repeats`` the others have rows as well,
    status ``repeat_call`` or ``repeat_result``, equal ones one row. ``level`` orders calls topologically; it is null on
    and after cycles and for repeats. Dependencies that no call has are counted in missing_deps and otherwise ignored.
    Arguments that are null, no JSON, or JSON with numbers that are not finite or lone surrogates are invalid and kept as
    text. ``json`` has sorted keys and no white space; equal calls give equal bytes. Other columns do not matter. Empty
    tables: no rows.
    """
    bound_batches(calls.sparkSession)
    scoped = "conv_id" in results.columns
    empty = F.array().cast("array<string>")
    text = lambda c: F.col(c).cast("string")
    conv = text("conv_id")
    key = lambda call: _key(conv, call) if scoped else call
    deps = F.coalesce(F.col("depends_on").cast("array<string>"), empty)
    call = F.struct(text("name").alias("name"), text("arguments").alias("arguments"), deps.alias("depends_on"), conv.alias("conv_id"), text("call_id").alias("call_id"))
    one = calls.select(key(text("call_id")).alias("key"), call.alias("c"))
    got = results.select(key(text("call_id")).alias("r_key"), (conv if scoped else F.lit(None).cast("string")).alias("r_conv"), text("call_id").alias("r_id"), text("content").alias("content"))
    found = got.where("r_key is not null").groupBy("r_key").agg(F.min("content").alias("content"), F.count("*").alias("n_results"), F.min("r_conv").alias("r_conv"), F.min("r_id").alias("r_id"))
    own = checkpointed(one.where("key is not null").groupBy("key").agg(F.min("c").alias("c"), F.count("*").alias("n_calls")))
    asked = own.select(F.col("key").alias("id"), F.explode(F.array_distinct("c.depends_on")).alias("on"), F.col("c.conv_id").alias("conv_id")).where("on is not null")
    edges = asked.select("id", (_key(F.col("conv_id"), F.col("on")) if scoped else F.col("on")).alias("on"))
    ids = own.select(F.col("key").alias("id"))
    held = checkpointed(edges.join(ids.withColumnRenamed("id", "on"), "on", "left_semi").select("id", "on"))
    lost = edges.groupBy("id").agg(F.count("*").alias("asked")).join(held.groupBy("id").agg(F.count("*").alias("there")), "id", "left").select(F.col("id").alias("_id"), (F.col("asked") - F.coalesce("there", F.lit(0))).alias("missing_deps"))
    level = _all_levels(own, ids, held, local_calls if scoped else 0).select(F.col("id").alias("_id2"), "level")
    table = {k: dict(v) for k, v in schemas.items()}

    @arrow_udf("valid boolean, errors string, json string")
    def judge(call_id: pa.Array, name: pa.Array, arguments: pa.Array, content: pa.Array, is_call: pa.Array) -> pa.Array:
        rows = []
        for i, n, a, c, called in zip(*(x.to_pylist() for x in (call_id, name, arguments, content, is_call)), strict=True):
            if not called:
                rows.append((None, None, canonical({"id": i, "result": c})))
                continue
            try:
                parsed = parse_arguments(a) if a is not None else None
                errors = argument_errors(parsed, table.get(n))
            except (ValueError, RecursionError):
                parsed, errors = a, ["no JSON"]
            rows.append((not errors, "; ".join(errors), canonical({"id": i, "name": n, "arguments": parsed, "result": c})))
        valid, errors, out = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(out, pa.string())], names=["valid", "errors", "json"])

    # Before the join with results: orphans have no call id, and all of them would meet in one task.
    own = own.join(lost, F.col("key") == F.col("_id"), "left").join(level, F.col("key") == F.col("_id2"), "left").drop("_id", "_id2")
    both = own.join(found, F.col("key") == F.col("r_key"), "full")
    whole = both.select("c", "n_calls", "missing_deps", "level", "r_conv", "r_id", "content", "n_results", F.lit(None).cast("string").alias("as"))
    rest = [
        (one.where("key is null").select("c", F.lit(1).alias("n_calls")), "no_id"),
        (got.where("r_key is null").select("r_conv", "r_id", "content", F.lit(1).alias("n_results")), "no_id"),
    ]
    if repeats:
        standing = own.where("n_calls > 1").select("key", F.col("c").alias("first"))
        more = split_join(one.where("key is not null").groupBy("key", "c").agg(F.count("*").alias("n_calls")), standing, ["key"])
        rest.append((more.where("c <> first").select("c", "n_calls"), "repeat_call"))
        standing = found.where("n_results > 1").select("r_key", F.col("content").alias("first"))
        more = split_join(got.where("r_key is not null").groupBy("r_key", "r_conv", "r_id", "content").agg(F.count("*").alias("n_results")), standing, ["r_key"])
        rest.append((more.where("not content <=> first").select("r_conv", "r_id", "content", "n_results"), "repeat_result"))
    for rows, status in rest:
        whole = whole.unionByName(rows.withColumn("as", F.lit(status)), allowMissingColumns=True)
    is_call = F.col("n_calls").isNotNull()
    whole = whole.withColumn("id", F.coalesce("c.call_id", "r_id")).withColumn("j", judge("id", F.col("c.name"), F.col("c.arguments"), "content", is_call))
    status = F.coalesce("as", F.when(~is_call, "orphan").when(F.col("n_results").isNull(), "pending").otherwise("linked"))
    return whole.select(
        F.coalesce("c.conv_id", "r_conv").alias("conv_id"), F.col("id").alias("call_id"), status.alias("status"), F.col("c.name").alias("name"), "level",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.coalesce("missing_deps", F.lit(0)).cast("long").alias("missing_deps"), "j.valid", "j.errors", "j.json",
    )


def _all_levels(own: DataFrame, ids: DataFrame, held: DataFrame, local_calls: int) -> DataFrame:
    """(id, level) of calls (key, c) with dependencies ``held`` (id, on). Conversations of at most ``local_calls`` calls,
    which hold all their dependencies, are ordered one by one within tasks; the longer ones together, by joins."""
    if not local_calls:
        return call_levels(ids, held)
    conv = F.coalesce("c.conv_id", F.lit("")).alias("conv")  # calls without a conversation share one
    long_ = own.groupBy(conv).agg(F.count("*").alias("n")).where(F.col("n") > local_calls).select("conv")
    deps = held.groupBy("id").agg(F.collect_list("on").alias("on"))
    placed = own.select(conv, F.col("key").alias("id"))
    short = placed.join(long_, "conv", "left_anti").join(deps, "id", "left").select("conv", "id", "on")
    found = local_levels(short)
    far = checkpointed(placed.join(long_, "conv", "left_semi").select("id"))
    if far.isEmpty():
        return found
    return found.union(call_levels(far, held.join(far, "id", "left_semi")))
