"""Strongly connected components and reach of directed networks, block by block.

A block of the network, such as a cell of some kilometres, is condensed within one task. What is left of it for the whole
is a small graph of its own components that lie on a way through it. These graphs are merged into larger blocks and
condensed again, so that rounds follow the logarithm of the number of blocks. Where a graph of components stays too large
for one task, its components are found by colours, which spread block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.session import checkpointed

#: Arcs that a task holds at most, and bits of the block id that one round of merging drops.
BLOCK_ARCS, MERGED_BITS = 400_000, 4
#: What a row of a block is: an arc inside, an arc that leaves from ``a``, one that comes in at ``a``, a start at ``a``.
INSIDE, LEAVES, ENTERS, START = 0, 1, 2, 3
#: Where a row has no second node. No null: ids beyond 2^53 would not survive it in pandas.
NOTHING = 0


def csr(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[int]]:
    """Heads of the arcs by tail, and where those of a tail begin."""
    order = np.argsort(src, kind="stable")
    begins = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=begins[1:])
    return dst[order].tolist(), begins.tolist()


def local_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The strong component of each of n nodes; a component is numbered after all that it leads to."""
    heads, begins = csr(n, src, dst)
    index, low, comp, at = [-1] * n, [0] * n, [-1] * n, begins[:-1].copy()
    seen, found, path = 0, 0, []
    for root in range(n):
        if index[root] >= 0:
            continue
        calls = [root]
        index[root] = low[root] = seen
        seen += 1
        path.append(root)
        while calls:
            v = calls[-1]
            if at[v] < begins[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = seen
                    seen += 1
                    path.append(w)
                    calls.append(w)
                elif comp[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
                continue
            calls.pop()
            if calls and low[v] < low[calls[-1]]:
                low[calls[-1]] = low[v]
            if low[v] == index[v]:
                while True:
                    w = path.pop()
                    comp[w] = found
                    if w == v:
                        break
                found += 1
    return np.array(comp, np.int64)


class Block:
    """The rows of one block (kind, a, b), condensed."""

    def __init__(self, pdf: pd.DataFrame):
        kind, a, b = (pdf[c].to_numpy() for c in ("kind", "a", "b"))
        inside = kind == INSIDE
        self.nodes, code = np.unique(np.concatenate([a, b[inside]]), return_inverse=True)
        tails, heads = code[: len(a)], code[len(a) :]
        self.at = {k: np.unique(tails[kind == k]) for k in (LEAVES, ENTERS, START)}
        self.src, self.dst = tails[inside], heads
        self.comp = local_components(len(self.nodes), self.src, self.dst)
        self.n = int(self.comp.max()) + 1 if len(self.nodes) else 0
        #: the smallest node of each component
        self.rep = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(self.rep, self.comp, self.nodes)
        arcs = np.stack([self.comp[self.src], self.comp[self.dst]])
        self.arcs = np.unique(arcs[:, arcs[0] != arcs[1]], axis=1)  # by tail, so that all heads come before their tails

    def live(self, first: np.ndarray) -> np.ndarray:
        """Components that ``first`` nodes lead to and that lead out of the block."""
        leads, led = np.zeros(self.n, bool), np.zeros(self.n, bool)
        leads[self.comp[self.at[LEAVES]]] = True
        led[self.comp[first]] = True
        pairs = list(zip(*self.arcs.tolist(), strict=True))
        for tail, head in pairs:
            if leads[head]:
                leads[tail] = True
        for tail, head in reversed(pairs):
            if led[tail]:
                led[head] = True
        return leads & led

    def live_arcs(self, live: np.ndarray) -> np.ndarray:
        return self.arcs[:, live[self.arcs[0]] & live[self.arcs[1]]]


def _condense(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, comp, live, head, block): the component of each node, and arcs comp -> head of those on a way through."""
    block = Block(pdf)
    live = block.live(block.at[ENTERS])
    arcs = block.live_arcs(live)
    own = pd.DataFrame({"node": block.nodes, "comp": block.rep[block.comp], "live": live[block.comp], "head": None})
    more = pd.DataFrame({"node": None, "comp": block.rep[arcs[0]], "live": True, "head": block.rep[arcs[1]]})
    out = pd.concat([own.astype({"node": "Int64", "head": "Int64"}), more.astype({"node": "Int64", "head": "Int64"})])
    return out.assign(block=pdf["block"].iloc[0])


def _nothing():
    return F.lit(NOTHING).cast("long")


def _rows(arcs: DataFrame) -> DataFrame:
    """(block, kind, a, b) of arcs (src, dst, sb, db); b is nothing but for arcs inside."""
    ends = arcs.where("sb <> db").select(F.explode(F.array(
        F.struct(F.col("sb").alias("block"), F.lit(LEAVES).alias("kind"), F.col("src").alias("a")), F.struct(F.col("db").alias("block"), F.lit(ENTERS).alias("kind"), F.col("dst").alias("a")),
    )).alias("e")).select("e.*").distinct()
    return arcs.where("sb = db").select(F.col("sb").alias("block"), F.lit(INSIDE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).union(ends.select("block", "kind", "a", _nothing().alias("b")))


def placed_arcs(edges: DataFrame, nodes: DataFrame, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """(src, dst, sb, db): edges (src, dst) between nodes (node, block), each once, with the blocks of their ends.

    A block that more than ``block_arcs`` arcs leave is split into parts by a hash of the node.
    """
    nodes = checkpointed(nodes.select("node", "block"))
    tails = checkpointed(edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("src"), F.col("block").alias("sb")), "src"))
    size = tails.groupBy("sb").agg(F.count("*").alias("n")).where(F.col("n") > block_arcs).select(F.col("sb").alias("block"), F.ceil(F.col("n") / block_arcs).alias("parts"))
    size = checkpointed(size)
    if size.isEmpty():
        return checkpointed(tails.join(nodes.select(F.col("node").alias("dst"), F.col("block").alias("db")), "dst").select("src", "dst", "sb", "db"), instead_of=tails)
    part = F.xxhash64("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    homes = nodes.select("node", "block").join(size, "block", "left").select("node", F.when(F.col("parts").isNull(), F.col("block")).otherwise(part).alias("block"))
    home = lambda end, name: homes.select(F.col("node").alias(end), F.col("block").alias(name))
    return checkpointed(tails.drop("sb").join(home("src", "sb"), "src").join(home("dst", "db"), "dst").select("src", "dst", "sb", "db"))


def _merged(arcs: DataFrame, block_arcs: int) -> DataFrame | None:
    """``arcs`` with larger blocks, each of at most ``block_arcs`` arcs; None if no two blocks can be merged."""
    if arcs.count() <= block_arcs:
        return arcs.withColumn("sb", F.lit(0).cast("long")).withColumn("db", F.lit(0).cast("long"))
    shifts = F.explode(F.array(*[F.lit(i) for i in range(MERGED_BITS, 64, MERGED_BITS)])).alias("by")
    up = lambda c, by: F.expr(f"shiftrightunsigned({c}, {by})")
    blocks = arcs.groupBy("sb").agg(F.count("*").alias("n")).select("sb", "n", shifts)
    fits = blocks.groupBy("by", up("sb", "by").alias("up")).agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).where(F.col("n") <= block_arcs)
    fits = checkpointed(fits)
    least = fits.where("blocks > 1").agg(F.min("by")).first()[0]
    if least is None:
        return None
    for c in ("sb", "db"):
        to = fits.where(F.col("by") == least).select(F.col("up").alias(f"{c}_up"))
        # a block that stays gets an id that no merged one has
        arcs = arcs.join(to, up(c, least) == F.col(f"{c}_up"), "left").withColumn(c, F.coalesce(f"{c}_up", F.xxhash64(c))).drop(f"{c}_up")
    return arcs


def strong_components(edges: DataFrame, nodes: DataFrame, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """(node, component) of nodes (node, block): component is the smallest node of those that lead to each other along edges
    (src, dst). Blocks may be any, but rounds are few and small if near nodes share a block and near blocks the leading
    bits of their ids. Edges with an end that is no node are left out; a node without edges is its own component.
    """
    arcs = placed_arcs(edges, nodes, block_arcs)
    steps, met = [], set()
    while not arcs.isEmpty():
        found = checkpointed(_rows(arcs).groupBy("block").applyInPandas(_condense, "node long, comp long, live boolean, head long, block long"))
        step = found.where("node is not null")
        steps.append(step.select("node", "comp"))
        live = step.where("live").select("node", "comp")
        end = lambda c: live.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))  # noqa: E731, B023
        cross = arcs.where("sb <> db").join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst"), "sb", "db").distinct()
        inner = found.where("head is not null").select(F.col("comp").alias("src"), F.col("head").alias("dst"), F.col("block").alias("sb"), F.col("block").alias("db"))
        left = checkpointed(inner.unionByName(cross), instead_of=arcs)
        if left.where("sb <> db").isEmpty():
            break
        larger = _merged(left, block_arcs)
        if larger is None:
            steps.append(coloured(left))
            break
        arcs = checkpointed(larger, instead_of=left)
    out = nodes.select("node", F.col("node").alias("component"))
    for step in steps:
        out = out.join(step.select(F.col("node").alias("component"), "comp"), "component", "left").select("node", F.coalesce("comp", "component").alias("component"))
    return _named_by_smallest(out)


def _named_by_smallest(found: DataFrame) -> DataFrame:
    small = found.groupBy("component").agg(F.min("node").alias("small")).where("small <> component")
    return found.join(small, "component", "left").select("node", F.coalesce("small", "component").alias("component"))


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """The largest label that reaches each node within a block, and each node outside that an arc leads to. Labels are
    the ``b`` of the rows that start."""
    block, inside = pdf["block"].iloc[0], (pdf["kind"] == INSIDE).to_numpy()
    arcs, labels = pdf[inside], pdf[~inside]
    then: dict[int, list[tuple[int, int]]] = {}
    for src, dst, far in zip(arcs["a"].tolist(), arcs["b"].tolist(), arcs["far"].tolist(), strict=True):
        then.setdefault(src, []).append((dst, far))
    best: dict[tuple[int, int], int] = {}
    for label, node in sorted(zip(labels["b"].tolist(), labels["a"].tolist(), strict=True), reverse=True):
        stack = [(node, block)]
        while stack:
            at = stack.pop()
            if at in best:
                continue
            best[at] = label  # labels come from the largest, so the first that arrives stays
            if at[1] == block:
                stack += [x for x in then.get(at[0], []) if x not in best]
    rows = [(n, b, label, b != block) for (n, b), label in best.items()]
    return pd.DataFrame(rows, columns=["node", "block", "label", "leaves"])


def spread(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, block, label): the largest label of labels (node, block, label) from which arcs (src, dst, sb, db) lead to each
    node; nodes that none leads to get no row. A round walks the blocks that a larger label has come into."""
    steps = arcs.select(F.col("sb").alias("block"), F.lit(INSIDE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("db").alias("far"))
    known = checkpointed(labels.select("node", "block", "label"))
    active = checkpointed(known.select("block").distinct())
    while not active.isEmpty():
        begun = known.select("block", F.lit(START).alias("kind"), F.col("node").alias("a"), F.col("label").alias("b"), F.col("block").alias("far"))
        rows = steps.union(begun).join(active, "block", "left_semi")
        found = checkpointed(rows.groupBy("block").applyInPandas(_spread, "node long, block long, label long, leaves boolean"))
        old = known.select("node", F.col("label").alias("old"))
        best = checkpointed(known.unionByName(found.drop("leaves")).groupBy("node", "block").agg(F.max("label").alias("label")))
        came = found.where("leaves").join(old, "node", "left").where("old is null or label > old")
        active = checkpointed(came.select("block").distinct(), instead_of=active)
        known = best
    return known


def shuffled_labels(ends: DataFrame) -> DataFrame:
    """(node, block, label): each node with a number of its own, in no order, so that the largest of a set is a random one."""
    for seed in range(64):
        labelled = ends.select("node", "block", F.xxhash64("node", F.lit(seed)).alias("label"))
        n, different = labelled.agg(F.count("*"), F.count_distinct("label")).first()
        if n == different:
            return labelled
    raise RuntimeError("no seed gives every node a number of its own")


def coloured(arcs: DataFrame) -> DataFrame:
    """(node, comp) of the ends of arcs (src, dst, sb, db), by colours: each node takes the colour of the node of largest
    label that leads to it, and of those with one colour the ones that lead back to that node are a component. All
    colours go at once; the others go on among their own colour. Labels in no order keep paths from losing one node a
    round."""
    parts, left = [], arcs
    while not left.isEmpty():
        ends = left.select(F.col("src").alias("node"), F.col("sb").alias("block")).union(left.select("dst", "db")).distinct()
        labels = checkpointed(shuffled_labels(ends))
        colour = checkpointed(spread(left, labels))
        of = lambda end: colour.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: E731, B023
        same = checkpointed(left.join(of("src"), "src").join(of("dst"), "dst").where("src_label = dst_label").select("src", "dst", "sb", "db"))
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("db").alias("sb"), F.col("sb").alias("db"))
        found = checkpointed(spread(back, colour.join(labels, ["node", "label"], "left_semi").select("node", "block", "label")))
        root = found.groupBy("label").agg(F.min("node").alias("comp"))
        parts.append(found.join(root, "label").select("node", "comp"))
        rest = colour.join(found, "node", "left_anti").select("node")
        left = checkpointed(same.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        if left.isEmpty():
            parts.append(rest.select("node", F.col("node").alias("comp")))
        else:
            inside = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
            parts.append(rest.join(inside, "node", "left_anti").select("node", F.col("node").alias("comp")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return checkpointed(out)


def _through(pdf: pd.DataFrame) -> pd.DataFrame:
    """(src, dst): ways through a block between ends of its arcs and starts, by way of its components' smallest nodes."""
    block = Block(pdf)
    first = np.union1d(block.at[ENTERS], block.at[START])
    live = block.live(first)
    arcs = block.live_arcs(live)
    parts = [(block.rep[arcs[0]], block.rep[arcs[1]])]
    for ends, inward in ((first, True), (block.at[LEAVES], False)):
        ends = ends[live[block.comp[ends]]]
        rep, node = block.rep[block.comp[ends]], block.nodes[ends]
        other = rep != node
        parts.append((node[other], rep[other]) if inward else (rep[other], node[other]))
    src, dst = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame({"dir": pdf["dir"].iloc[0], "src": src, "dst": dst})


def _walk(heads: dict, starts: list[int]) -> set[int]:
    seen, stack = set(starts), list(starts)
    while stack:
        for m in heads.get(stack.pop(), ()):
            if m not in seen:
                seen.add(m)
                stack.append(m)
    return seen


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node) that the starts of a block lead to inside it."""
    inside = pdf[pdf["kind"] == INSIDE]
    heads: dict[int, list[int]] = {}
    for a, b in zip(inside["a"].tolist(), inside["b"].tolist(), strict=True):
        heads.setdefault(a, []).append(b)
    seen = _walk(heads, pdf[pdf["kind"] == START]["a"].tolist())
    return pd.DataFrame({"dir": pdf["dir"].iloc[0], "node": sorted(seen)})


def reach(edges: DataFrame, nodes: DataFrame, starts: DataFrame, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """(dir, node): the nodes (node, block) that starts (dir, node) lead to, along edges (src, dst) where dir is 0 and
    against them where it is 1.

    Every block is walked twice, both ways at once: first for the ways through it, then, once it is known which of its
    ends are reached, for all its nodes. In between only the ways through and the arcs between blocks are followed: in one
    task if they are at most ``block_arcs``, else in rounds.
    """
    arcs = placed_arcs(edges, nodes, block_arcs)
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("db").alias("sb"), F.col("sb").alias("db"))
    dirs = [_rows(a).withColumn("dir", F.lit(d)) for d, a in enumerate((arcs, back))]
    homes = arcs.select(F.col("src").alias("node"), F.col("sb").alias("block")).union(arcs.select("dst", "db")).distinct()
    starts = starts.select("dir", "node").distinct()
    at = homes.join(starts, "node")
    begun = at.select("block", F.lit(START).alias("kind"), F.col("node").alias("a"), _nothing().alias("b"), "dir")
    rows = checkpointed(dirs[0].unionByName(dirs[1]))
    through = rows.unionByName(begun).groupBy("dir", "block").applyInPandas(_through, "dir int, src long, dst long")
    cross = arcs.where("sb <> db").select(F.lit(0).alias("dir"), "src", "dst").union(back.where("sb <> db").select(F.lit(1), "src", "dst"))
    ways = checkpointed(through.union(cross).distinct())
    ends = _followed(ways, at.select("dir", "node"), block_arcs)
    again = homes.join(ends, "node").select("block", F.lit(START).alias("kind"), F.col("node").alias("a"), _nothing().alias("b"), "dir")
    inside = rows.where(F.col("kind") == INSIDE).unionByName(again).groupBy("dir", "block").applyInPandas(_reached, "dir int, node long")
    alone = nodes.select("node").join(starts, "node").select("dir", "node")  # starts that no arc meets
    return checkpointed(inside.union(alone).distinct())


def _followed(ways: DataFrame, starts: DataFrame, block_arcs: int) -> DataFrame:
    """(dir, node) that starts (dir, node) lead to along ways (dir, src, dst), starts included."""
    if ways.count() + starts.count() <= block_arcs:

        def follow(pdf: pd.DataFrame) -> pd.DataFrame:
            begins = (pdf["kind"] == START).to_numpy()
            heads: dict[int, list[int]] = {}
            for a, b in zip(*(pdf[c][~begins].tolist() for c in ("a", "b")), strict=True):
                heads.setdefault(a, []).append(b)
            return pd.DataFrame({"dir": pdf["dir"].iloc[0], "node": sorted(_walk(heads, pdf["a"][begins].tolist()))})

        rows = ways.select("dir", F.lit(INSIDE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
        rows = rows.union(starts.select("dir", F.lit(START), "node", _nothing()))
        return rows.groupBy("dir").applyInPandas(follow, "dir int, node long")
    known = edge = checkpointed(starts)
    while not edge.isEmpty():
        step = edge.withColumnRenamed("node", "src").join(ways, ["dir", "src"]).select("dir", F.col("dst").alias("node")).distinct()
        edge = checkpointed(step.join(known, ["dir", "node"], "left_anti"))
        known = checkpointed(known.union(edge))
    return known
