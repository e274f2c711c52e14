"""Graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.session import checkpointed

#: Links that a task joins at once.
STAR_LINKS = 200_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` of rows with totals of the same keys.

    Totals come partitioned by their keys, and a join that makes use of it cannot be split: a key that a third of the
    rows have would land in one task. Joined on the keys as a struct, both sides are dealt anew, and adaptive execution
    splits such a key. Null keys meet no totals.
    """
    own = left.withColumn("_key", F.struct(*keys))
    totals = right.select(F.struct(*keys).alias("_key"), *[c for c in right.columns if c not in keys])
    return own.join(totals, "_key", how).drop("_key")


def joined_stars(src: np.ndarray, dst: np.ndarray, value: np.ndarray, limits: tuple[float, ...]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each limit, smallest first, the nodes that links of at most that value join to a smaller node, and the smallest
    node that they lead to."""
    nodes, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    up = list(range(len(nodes)))
    order = np.argsort(value, kind="stable")
    a, b, value = code[: len(src)][order].tolist(), code[len(src) :][order].tolist(), value[order]
    done = 0
    for limit in limits:
        end = int(np.searchsorted(value, limit, side="right"))
        for i, j in zip(a[done:end], b[done:end], strict=True):
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            if i != j:
                up[max(i, j)] = min(i, j)
        done = end
        root = np.array(up, np.int64)
        while (root[root] != root).any():
            root = root[root]
        apart = np.flatnonzero(root != np.arange(len(root)))
        yield limit, nodes[apart], nodes[root[apart]]


def near_stars(links: DataFrame, place: list[Column], limits: tuple[float, ...] = (0.0,), value: str | None = None) -> DataFrame:
    """(limit, src, dst): stars that join the same nodes as links (src, dst) of at most ``limit`` by ``value`` (all of them
    without it), for each limit.

    Links that share a ``place`` meet in a task, which joins some at a time, so that a component that lies in one place
    leaves it as one star around its smallest node. What lies in several is left to ``connected_components``. Nodes are
    longs.
    """
    rows = links.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (F.col(value) if value else F.lit(0.0)).cast("double").alias("value"), F.hash(*place).alias("place"))
    rows = rows.where("src is not null and dst is not null").repartition("place").drop("place")
    schema = pa.schema([("limit", pa.float64()), ("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("src", "dst", "value")]
            for limit, node, root in joined_stars(*columns, limits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), limit)), pa.array(node), pa.array(root)], schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= STAR_LINKS:
                yield from stars(held)
                held = []
        if held:
            yield from stars(held)

    return rows.mapInArrow(run, "limit double, src long, dst long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is the smallest node reachable.

    Alternates two star steps until the edge set no longer changes: every node hands its larger neighbours to
    its smallest neighbour, then its smaller ones. All edges end as stars around the smallest node, after a number
    of rounds that grows with the logarithm of the longest path. Each round is a table of its own, so rounds cost alike.
    Minima are combined before the shuffle, so a hub costs one row per task; the joins back are plain equi-joins that
    adaptive execution can split. Null ends and self loops are ignored apart from naming their node.
    """
    clean = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    loops = clean.select(F.col("a").alias("node")).union(clean.select(F.col("b").alias("node"))).distinct()
    state = checkpointed(
        clean.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _fingerprint(state)
    for _ in range(max_rounds):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = split_join(large, low2, ["u"])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low2.select("u", F.col("m").alias("v"))
        )
        state = checkpointed(small.distinct(), instead_of=state)
        now = _fingerprint(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = loops.join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.union(roots)
