"""Strong components and reach against plain walks, on random graphs, blocks of all kinds and every fallback."""

from __future__ import annotations

import random

import pytest

from roadloom.operators import components as C
from roadloom.operators import reach as R


def frames(spark, pairs, nodes, block):
    return spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(n, block(n)) for n in nodes], "node long, block long")


def walks(pairs, nodes):
    """What each node leads to, itself included."""
    then = {n: set() for n in nodes}
    for a, b in pairs:
        if a in then and b in then:
            then[a].add(b)
    out = {}
    for n in nodes:
        seen, stack = {n}, [n]
        while stack:
            for m in then[stack.pop()] - seen:
                seen.add(m)
                stack.append(m)
        out[n] = seen
    return out


def plain_components(pairs, nodes):
    to = walks(pairs, nodes)
    return {n: min(m for m in to[n] if n in to[m]) for n in nodes}


BIG = 1 << 60
CASES = [(40, 50, lambda n: n % 5, 400_000), (60, 75, lambda n: n // 4 - 7, 25), (16, 22, lambda n: n // 2, 1)]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_components_equal_plain_walks(spark, case):
    n, m, block, most = CASES[case]
    rng = random.Random(case)
    nodes = [BIG + i for i in range(n)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)] + [(BIG, BIG), (BIG, 5), (7, BIG)]
    edges, places = frames(spark, pairs, nodes, lambda i: block(i - BIG))
    got = C.strong_components(edges, places, most).collect()
    assert len(got) == n and {r.node: r.component for r in got} == plain_components(pairs, nodes)


@pytest.mark.parametrize("case", range(len(CASES)))
def test_reach_equals_plain_walks(spark, case):
    n, m, block, most = CASES[case]
    rng = random.Random(100 + case)
    nodes = list(range(n))
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m * 2 // 3)]
    starts = [(0, rng.choice(nodes)) for _ in range(2)] + [(1, rng.choice(nodes)), (0, n + 5)]
    edges, places = frames(spark, pairs, nodes, block)
    got = [tuple(r) for r in C.reach(edges, places, spark.createDataFrame(starts, "dir int, node long"), most).collect()]
    to, back = walks(pairs, nodes), walks([(b, a) for a, b in pairs], nodes)
    assert len(got) == len(set(got))
    assert set(got) == {(d, x) for d, s in starts if s in to for x in (back if d else to)[s]}


def test_no_edges(spark):
    edges, places = frames(spark, [], [3, 4], lambda n: n)
    assert sorted(map(tuple, C.strong_components(edges, places).collect())) == [(3, 3), (4, 4)]
    assert C.reach(edges, places, spark.createDataFrame([(1, 4)], "dir int, node long")).collect() == [(1, 4)]
    assert [r.node for r in R.largest_scc(edges, places).collect()] == [3]


def count_calls(monkeypatch, name):
    calls, plain = [], getattr(C, name)
    monkeypatch.setattr(C, name, lambda *a: calls.append(1) or plain(*a))
    return calls


def test_rounds_do_not_follow_the_number_of_components(spark, monkeypatch):
    """An acyclic graph of 10,000 nodes, every node its own component, in blocks along its order."""
    rng = random.Random(1)
    n = 10_000
    pairs = [(i, min(n - 1, i + rng.randint(1, 40))) for i in range(n - 1) for _ in range(3)]
    edges, places = frames(spark, pairs, range(n), lambda i: i // 50)
    rounds = count_calls(monkeypatch, "_rows")
    got = C.strong_components(edges, places).collect()
    assert len(got) == n and all(r.node == r.component for r in got) and len(rounds) <= 2


def test_colours_of_a_path_take_few_rounds(spark, monkeypatch):
    """Thirty nodes in one line, against their order, none in a circle."""
    arcs = spark.createDataFrame([(i, i - 1, 0, 0) for i in range(1, 31)], "src long, dst long, sb long, db long")
    rounds = count_calls(monkeypatch, "shuffled_labels")
    got = C.coloured(arcs).collect()
    assert sorted(r.node for r in got) == list(range(31)) and all(r.node == r.comp for r in got)
    assert len(rounds) <= 10


def test_long_paths_do_not_recurse():
    import numpy as np

    n = 50_000
    src = np.arange(n - 1)
    assert len(set(C.local_components(n, src, src + 1))) == n
    assert len(set(C.local_components(n, np.append(src, n - 1), np.append(src + 1, 0)))) == 1
