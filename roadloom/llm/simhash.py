"""SimHash near-duplicates: fingerprints, a binary trie self-join, components.

The 64 bits of a fingerprint are cut into five blocks. Two fingerprints that differ in at most 3 bits agree on at least
two of them, so each distinct fingerprint goes to ten places, one for each pair of blocks, turned so that these two come
first. Those with the same first blocks are a node of the place's binary trie, and a trie is joined with itself: pairs of
nodes go down together, differing bits add up, and a pair is left once they exceed the budget. Small node pairs go down
within a task, large ones are first split into pairs of child nodes by Spark. Only edges that join two components of a
node pair are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import bound_batches, text_sha256, with_verdicts
from roadloom.operators.graph import connected_components, split_join
from roadloom.session import checkpointed

BITS = 64
#: Widths of the blocks, from the highest bit, and the differing bits that they allow for.
WIDTHS, MOST_BITS = (13, 13, 13, 13, 12), 3
#: A pair of trie nodes with more fingerprints than this is split by the next bits into pairs of their children.
PLACE_ROWS, SPLIT_BITS = 20_000, 8
#: Pairs of trie nodes that a task holds at once.
FRONTIER = 400_000


def simhash64(text: str | None) -> int:
    """A-Z lower-cased, three-word shingles with repeats, XXH64 with seed 42; a bit is set if over half have it."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:], strict=False)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        set_bits += np.unpackbits(hashes[lo : lo + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, fp) with the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([simhash64(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.string()), pa.array(values)], schema=schema)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text", text_sha256().alias("text_sha256")).mapInArrow(run, "doc_id long, text_sha256 string, fp long")


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def labels(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


def trie_self_join(keys: np.ndarray, roots: np.ndarray, budget: int, frontier: int = FRONTIER) -> list[tuple[int, int]]:
    """``trie_join`` of every root with itself; ``roots`` has the bounds of each root's range of ``keys``."""
    lo, hi = roots[:-1], roots[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    return trie_join(keys, lo, hi, lo, hi, budget, frontier)


def trie_join(keys: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int, frontier: int = FRONTIER) -> list[tuple[int, int]]:
    """Edges (i, j) that span the components of keys differing in at most ``budget`` bits, one of a pair's first and one of
    its second range.

    ``keys`` are unsigned longs, sorted within each range a0 to a1 and b0 to b1; a pair is two equal ranges or two that
    share no key. A node is a range of sorted keys with a common prefix. Pairs of nodes wait on a stack in blocks of at
    most ``frontier``; a pair whose keys are all in one component already is left as well, since it can add no edge that
    matters.
    """
    n = len(keys)
    union, edges = _Union(n), []
    stack = [(0, *(x.astype(np.int64) for x in (a0, a1, b0, b1)), np.zeros(len(a0), np.int64))]
    one = np.uint64(1)
    prefix_label = union.labels()
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        # Pairs of single keys, and pairs at the last bit, are settled at once.
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            off = i != j
            i, j = i[off], j[off]
            close = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            i, j = i[close], j[close]
            while len(i):  # a few at a time: each round of links makes most of the others needless
                apart = prefix_label[i] != prefix_label[j]
                i, j = i[apart], j[apart]
                for x, y in zip(i[:4096].tolist(), j[:4096].tolist(), strict=True):
                    p, q = union.find(x), union.find(y)
                    if p != q:
                        union.up[max(p, q)] = min(p, q)
                        edges.append((x, y))
                i, j = i[4096:], j[4096:]
                prefix_label = union.labels()
        rest = ~single
        if bit == BITS or not rest.any():
            continue
        a0, a1, b0, b1, diff = a0[rest], a1[rest], b0[rest], b1[rest], diff[rest]
        # A pair wholly inside one component can be left.
        wide = (a1 - a0) + (b1 - b0)
        if bit % 8 == 0 and bit and len(a0) > 1000 and (wide > 64).any():
            same = prefix_label[a0] == prefix_label[b0]
            for k in np.nonzero(same & (wide > 64))[0]:
                label = prefix_label[a0[k]]
                same[k] = (prefix_label[a0[k] : a1[k]] == label).all() and (prefix_label[b0[k] : b1[k]] == label).all()
            same &= (wide > 64)
            a0, a1, b0, b1, diff = (x[~same] for x in (a0, a1, b0, b1, diff))
        if len(a0) > frontier:
            half = len(a0) // 2
            stack.append((bit, a0[half:], a1[half:], b0[half:], b1[half:], diff[half:]))
            stack.append((bit, a0[:half], a1[:half], b0[:half], b1[:half], diff[:half]))
            continue
        # First index in each range whose next bit is set: the count of unset bits by running sums.
        shift = np.uint64(BITS - 1 - bit)
        ones = np.concatenate([[0], np.cumsum(((keys >> shift) & one).astype(np.int64))]) if n < 4 * len(a0) else None
        if ones is not None:
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        else:
            am, bm = _first_set(keys, a0, a1, shift), _first_set(keys, b0, b1, shift)
        own = (a0 == b0) & (a1 == b1)
        other = ~own
        parts = [
            (a0, am, b0, bm, diff, None),
            (am, a1, bm, b1, diff, None),
            (a0, am, bm, b1, diff + 1, None),
            (am[other], a1[other], b0[other], bm[other], diff[other] + 1, None),
        ]
        na0, na1, nb0, nb1, nd = (np.concatenate([p[i] for p in parts]) for i in range(5))
        live = (na1 > na0) & (nb1 > nb0) & (nd <= budget) & ~((na0 == nb0) & (na1 - na0 == 1) & (nb1 - nb0 == 1))
        if live.any():
            stack.append((bit + 1, na0[live], na1[live], nb0[live], nb1[live], nd[live]))
    return edges


def _first_set(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.uint64) -> np.ndarray:
    """In each sorted range whose keys share the bits above, the first index with the bit at ``shift`` set."""
    lo, hi, one = lo.copy(), hi.copy(), np.uint64(1)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        is_set = ((keys[np.minimum(mid, len(keys) - 1)] >> shift) & one).astype(bool)
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)
    return lo


def _turned(first: tuple[int, int]) -> str:
    """SQL of the fingerprint with two blocks in front and the others after them in their order."""
    order = [*first, *(k for k in range(len(WIDTHS)) if k not in first)]
    parts, at = [], BITS
    for k in order:
        below = sum(WIDTHS[k + 1 :])
        at -= WIDTHS[k]
        parts.append(f"shiftleft(shiftrightunsigned(fp, {below}) & {(1 << WIDTHS[k]) - 1}, {at})")
    return " | ".join(parts)


#: A row's pair of nodes: the place, the bits of the nodes' prefixes, and the prefixes themselves.
PAIR = ["place", "depth", "na", "nb"]


def placed(prints: DataFrame) -> DataFrame:
    """(place, depth, na, nb, fp, turned): ten rows for each ``fp``, each in the pair of its node with itself."""
    spots = [(k, WIDTHS[i] + WIDTHS[j], _turned((i, j))) for k, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))]
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(depth).alias("depth"), F.expr(sql).alias("turned")) for k, depth, sql in spots])
    rows = prints.select("fp", F.explode(each).alias("t")).select("fp", "t.place", "t.depth", "t.turned")
    node = F.expr(f"shiftrightunsigned(turned, {BITS} - depth)")
    return rows.select("place", "depth", node.alias("na"), node.alias("nb"), "fp", "turned")


def split_pairs(rows: DataFrame, budget: int) -> DataFrame:
    """Rows of pairs of nodes as rows of pairs of these nodes' children, for pairs of children within the budget that both
    have rows. A pair of nodes has at most 2^SPLIT_BITS children on each side, whatever the number of its rows."""
    step = f"least({SPLIT_BITS}, {BITS} - depth)"
    below = rows.withColumn("child", F.expr(f"shiftrightunsigned(turned, {BITS} - depth - {step})")).withColumn("on_a", F.expr(f"shiftrightunsigned(turned, {BITS} - depth) = na"))
    nodes = checkpointed(below.select(*PAIR, "child", "on_a").distinct())
    a = nodes.where("on_a").select(*PAIR, F.col("child").alias("ca"))
    b = nodes.where("na = nb or not on_a").select(*PAIR, F.col("child").alias("cb"))
    pairs = a.join(b, PAIR).where(f"bit_count(ca ^ cb) <= {budget} and (na <> nb or ca <= cb)")
    ends = F.explode(F.array_distinct(F.array("ca", "cb"))).alias("child")
    return below.join(pairs.select(*PAIR, "ca", "cb", ends), [*PAIR, "child"]).select("place", F.expr(f"depth + {step}").cast("int").alias("depth"), F.col("ca").alias("na"), F.col("cb").alias("nb"), "fp", "turned")


def _pair_edges(batches: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by pair of nodes; whole pairs are gathered up to a few batches and joined at once."""

    def join(df: pd.DataFrame) -> pd.DataFrame:
        keys = df["turned"].to_numpy(np.int64).view(np.uint64)
        group = np.zeros(len(df), bool)
        group[0] = True
        for c in PAIR:
            x = df[c].to_numpy()
            group[1:] |= x[1:] != x[:-1]
        group = np.cumsum(group)
        order = np.lexsort((keys, group))
        keys, fps, group = keys[order], df["fp"].to_numpy(np.int64)[order], group[order]
        start = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
        end = np.r_[start[1:], len(keys)]
        # Of a pair of two nodes the keys of one come first; the second starts where the prefix changes.
        left = (BITS - df["depth"].to_numpy(np.uint64))[order]
        new = np.r_[True, (keys[1:] >> left[1:]) != (keys[:-1] >> left[:-1])]
        new[start] = False
        middle = np.full(len(start), -1)
        where = np.nonzero(new)[0]
        middle[np.searchsorted(start, where, "right") - 1] = where
        cross, alone = middle >= 0, (middle < 0) & (df["na"].to_numpy() == df["nb"].to_numpy())[order][start] & (end - start > 1)
        a0, a1 = np.r_[start[alone], start[cross]], np.r_[end[alone], middle[cross]]
        b0, b1 = np.r_[start[alone], middle[cross]], np.r_[end[alone], end[cross]]
        out = [(fps[i], fps[j]) for i, j in trie_join(keys, a0, a1, b0, b1, budget)]
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        if sum(map(len, held)) >= 50_000:
            df = pd.concat(held, ignore_index=True)
            mine = (df[PAIR] == df[PAIR].iloc[-1]).all(axis=1)
            if (~mine).any():
                yield join(df[~mine])
            held = [df[mine]]
    if held:
        yield join(pd.concat(held, ignore_index=True))


def near_edges(prints: DataFrame, budget: int = MOST_BITS, place_rows: int = PLACE_ROWS) -> DataFrame:
    """(src, dst) edges that span the components of distinct fingerprints ``fp`` within ``budget`` bits.

    Rows alone in a pair of nodes have no partner there and go at once. Pairs of over ``place_rows`` rows are split until
    none is left, five times at most, since a node with all its bits set down is a single fingerprint.
    """
    rows, found = placed(prints), []
    while True:
        size = rows.groupBy(*PAIR).agg(F.count("*").alias("n")).where("n > 1")
        own = checkpointed(split_join(rows, size, PAIR))
        too_many = (F.col("n") > place_rows) & (F.col("depth") < BITS)
        small = own.where(~too_many).select(*PAIR, "fp", "turned").repartition(*PAIR).sortWithinPartitions(*PAIR)
        found.append(small.mapInPandas(lambda it: _pair_edges(it, budget), "src long, dst long"))
        large = own.where(too_many)
        if large.isEmpty():
            break
        rows = checkpointed(split_pairs(large.select(*PAIR, "fp", "turned"), budget))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_dedup(docs: DataFrame, budget: int = MOST_BITS, place_rows: int = PLACE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept), a row for each row of ``docs`` (doc_id, text, any others).

    Documents link when their fingerprints differ in at most ``budget`` (up to 3) bits; component_id is the smallest
    doc_id reachable and ``kept`` marks the row that has it, of several the one whose text has the smallest SHA-256.
    Null, empty and blank texts have fingerprint zero and link like any other. Equal fingerprints are made one before the
    join and their rows joined back by an equi-join that adaptive execution can split, so a group of copies of any size
    costs a row per task. Null doc_ids are never a component's name; a component of null doc_ids only has a null name.
    Rows that agree in doc_id and text share their verdict. No rows: no rows.
    """
    return _judged(docs, budget, place_rows).drop("text_sha256")


def _judged(docs: DataFrame, budget: int = MOST_BITS, place_rows: int = PLACE_ROWS) -> DataFrame:
    """``near_dedup`` with the text_sha256 of each row."""
    if budget > MOST_BITS:
        raise ValueError("two of five blocks find pairs of at most 3 differing bits")
    rows = checkpointed(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")).alias("first")
    prints = checkpointed(rows.groupBy("fp").agg(first))
    comps = connected_components(near_edges(prints.select("fp"), budget, place_rows)).select(F.col("node").alias("fp"), "component")
    named = prints.join(comps, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("stays"))
    names = split_join(named.select("fp", "component"), firsts, ["component"]).select("fp", "stays")
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_sha256") == F.col("stays.text_sha256"))
    return rows.join(names, "fp").select("doc_id", "text_sha256", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("stays.doc_id").alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; all columns as they were."""
    return with_verdicts(docs, _judged(docs))
