"""Routes and reach over directed edges.

What can be reached is found block by block: a block of the network, such as a cell of some kilometres, is walked to its
end within one task, and only the steps that leave it go through a shuffle. So rounds follow the number of blocks that a
path crosses, not the number of its edges.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.text import base_id
from roadloom.operators.components import BLOCK_ARCS, reach, strong_components
from roadloom.operators.graph import split_join
from roadloom.session import checkpointed

_LABELS = "node long, block long, dist long, leaves boolean"


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least distances within one block from its labelled nodes, and the steps that leave it."""
    block = pdf["block"].iloc[0]
    arcs = pdf[pdf["dst"].notna()]
    then = defaultdict(list)
    for src, dst, far in zip(arcs["node"].tolist(), arcs["dst"].astype("int64").tolist(), arcs["dst_block"].astype("int64").tolist(), strict=True):
        then[src].append((dst, far))
    labels = pdf[pdf["dist"].notna()]
    heap = [(int(d), n) for n, d in zip(labels["node"].tolist(), labels["dist"].tolist(), strict=True)]
    heapq.heapify(heap)
    own, away = {}, {}
    while heap:
        d, n = heapq.heappop(heap)
        if n in own:
            continue
        own[n] = d
        for dst, far in then[n]:
            if far == block:
                if dst not in own:
                    heapq.heappush(heap, (d + 1, dst))
            elif d + 1 < away.get(dst, (d + 2, 0))[0]:
                away[dst] = (d + 1, far)
    rows = [(n, block, d, False) for n, d in own.items()] + [(n, far, d, True) for n, (d, far) in away.items()]
    return pd.DataFrame(rows, columns=["node", "block", "dist", "leaves"])


def hops_from(edges: DataFrame, seeds: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, dist): the least number of steps along edges (src, dst) from any of seeds (node); nodes out of reach get no
    row. ``blocks`` (node, block) gives every node its block, which must fit in one task with its edges."""
    home = lambda end: blocks.select(F.col("node").alias(end), F.col("block").alias(f"{end}_block"))
    arcs = checkpointed(edges.select("src", "dst").distinct().join(home("src"), "src").join(home("dst"), "dst").select(F.col("src_block").alias("block"), F.col("src").alias("node"), "dst", "dst_block"))
    known = checkpointed(seeds.select("node").distinct().join(blocks.select("node", "block"), "node").select("node", "block", F.lit(0).cast("long").alias("dist")))
    active = checkpointed(known.select("block").distinct())
    while not active.isEmpty():
        rows = arcs.unionByName(known, allowMissingColumns=True).join(active, "block", "left_semi")
        found = checkpointed(rows.groupBy("block").applyInPandas(_walk, _LABELS))
        best = checkpointed(known.unionByName(found.drop("leaves")).groupBy("node", "block").agg(F.min("dist").alias("dist")))
        old = known.select("node", F.col("dist").alias("old"))
        sent = found.where("leaves").groupBy("node", "block").agg(F.min("dist").alias("dist")).join(old, "node", "left").where("old is null or dist < old")
        active = checkpointed(sent.select("block").distinct(), instead_of=active)
        known = best
    return known.select("node", "dist")


def exit_hops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hops, next) of nodes (node, block): the least number of steps along edges (src, dst) to a node that nothing
    follows, and the first node on such a way, of several the smallest. An exit has no next; nodes from which none can be
    reached get no row. The chain of nexts is the way out, so no way is written for a node."""
    ends = nodes.select("node").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    dist = checkpointed(hops_from(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends, nodes))
    near = edges.join(dist.select(F.col("node").alias("src"), "dist"), "src").join(dist.select(F.col("node").alias("dst"), F.col("dist").alias("left")), "dst")
    step = near.where("left = dist - 1").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))
    return dist.join(step, "node", "left").select("node", F.col("dist").alias("hops"), "next")


def ways_out(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, path): the nodes after each of starts (node) along the nexts of steps (node, hops, next), empty for an exit.

    Only these ways are written. A place on a way is reached from its start by tables of 1, 2, 4, ... steps, so that the
    joins are as many as the longest way's length has digits in binary, and places, not ways, are what is joined.
    """
    own = checkpointed(starts.select("node").distinct().join(steps.select("node", "hops"), "node"))
    longest = own.agg(F.max("hops")).first()[0] or 0
    at = own.where("hops > 0").select("node", F.explode(F.sequence(F.lit(1), F.col("hops").cast("int"))).alias("place"), F.col("node").alias("now"))
    jump = checkpointed(steps.where("next is not null").select(F.col("node").alias("now"), F.col("next").alias("to")))
    for bit in range(longest.bit_length()):
        moved = split_join(at, jump, ["now"], "left")
        at = moved.select("node", "place", F.when(F.col("place").bitwiseAND(1 << bit) > 0, F.col("to")).otherwise(F.col("now")).alias("now"))
        if longest >> (bit + 1):
            at = checkpointed(at)
            jump = checkpointed(split_join(jump.withColumnRenamed("now", "from").withColumnRenamed("to", "now"), jump, ["now"]).select(F.col("from").alias("now"), "to"))
    paths = at.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "now"))), lambda s: s["now"]).alias("path"))
    kind = dict(steps.dtypes)["node"]
    return own.join(paths, "node", "left").select("node", F.coalesce("path", F.array().cast(f"array<{kind}>")).alias("path"))


def exit_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, path): the nodes after each of nodes (node, block) on the way of ``exit_hops``. Exits have an empty path, and so
    have nodes from which no exit can be reached. For all nodes this is much to write; ``ways_out`` gives a few."""
    found = ways_out(nodes, exit_hops(edges, nodes))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"))


def entry_exit_reach(edges: DataFrame, nodes: DataFrame, entries: DataFrame, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """(node, is_entry, is_exit, from_entry, to_exit) of nodes (node, block): whether any of ``entries`` (node) leads there
    and whether an exit, a node that nothing follows, can be reached. Both ways are walked at once, none per entry."""
    ends = checkpointed(nodes.select("node").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
    starts = entries.select(F.lit(0).alias("dir"), "node").union(ends.select(F.lit(1), "node"))
    found = reach(edges, nodes, starts, block_arcs).groupBy("node").agg(*[F.max(F.col("dir") == d).alias(c) for d, c in enumerate(("from_entry", "to_exit"))])
    flag = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(True))
    rows = nodes.select("node").join(found, "node", "left").join(flag(entries, "is_entry"), "node", "left").join(flag(ends, "is_exit"), "node", "left")
    return rows.select("node", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_entry", "is_exit", "from_entry", "to_exit")])


def largest_scc(edges: DataFrame, nodes: DataFrame, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """(node) of the largest set of nodes (node, block) of which each can be reached from each along edges (src, dst); of
    equal sets the one with the smallest node."""
    found = checkpointed(strong_components(edges, nodes, block_arcs))
    largest = found.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("component")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("component"))
    return found.join(largest, "component").select("node")


def cut_routes(routes: DataFrame, max_hops: int) -> DataFrame:
    """routes (veh, route array<string>) with ``cut`` and ``sid``: a route whose base id changes more than ``max_hops`` times
    ends at the edge past the cap, which is its sid. An empty route stays."""
    start = F.struct(F.lit(0).alias("hops"), F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("seen"), F.lit(0).alias("at"))

    def step(acc, sid):
        base = base_id(sid)
        hops = acc["hops"] + F.when(base.eqNullSafe(acc["last"]), 0).otherwise(1)
        seen = acc["seen"] + 1
        return F.struct(hops.alias("hops"), base.alias("last"), seen.alias("seen"), F.when((acc["at"] == 0) & (hops > max_hops), seen).otherwise(acc["at"]).alias("at"))

    at = routes.withColumn("at", F.aggregate("route", start, step, lambda a: a["at"]))
    kept = at.withColumn("cut", F.col("at") > 0).withColumn("route", F.when(F.col("cut"), F.slice("route", 1, F.greatest("at", F.lit(1)))).otherwise(F.col("route")))
    return kept.withColumn("sid", F.when(F.col("cut"), F.element_at("route", -1))).drop("at")


def cap_hops(routes: DataFrame, paths: DataFrame, max_hops: int) -> DataFrame:
    """(veh, cut, route) of ``cut_routes``; a route that is cut goes on by its edge's path of paths (sid, path), if any."""
    led = cut_routes(routes, max_hops).join(paths.select("sid", "path"), "sid", "left")
    return led.select("veh", "cut", F.concat("route", F.coalesce("path", F.array().cast("array<string>"))).alias("route"))


def lead_out(routes: DataFrame, steps: DataFrame, max_hops: int) -> DataFrame:
    """As ``cap_hops`` by the nexts of steps (node, hops, next): ways are written for the edges at which a route is cut."""
    cut = checkpointed(cut_routes(routes, max_hops))
    paths = ways_out(cut.where("cut").select(F.col("sid").alias("node")), steps).withColumnRenamed("node", "sid")
    led = split_join(cut, paths, ["sid"], "left")
    return led.select("veh", "cut", F.concat("route", F.coalesce("path", F.array().cast("array<string>"))).alias("route"))
