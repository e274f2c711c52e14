"""Contraction, faces, widths, contacts and reach on small networks with known answers."""

from __future__ import annotations

from collections import deque

import pytest
from pyspark.sql import functions as F

from roadloom.functions.geo import box_overlap
from roadloom.operators import faces as P
from roadloom.operators import reach as R
from roadloom.operators.contraction import contract_short_links
from roadloom.plans import topology as T

RING = "array<struct<x double, y double>>"


def box(x1, y1, x2, y2):
    return [(float(x), float(y)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]


def network(spark, spots, ends):
    """Nodes and straight links from {nid: (x, y)} and [(a, b)]."""
    nodes = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in spots.items()], "nid long, x double, y double")
    rows = []
    for k, (a, b) in enumerate(ends):
        (x1, y1), (x2, y2) = spots[a], spots[b]
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        rows.append((k, a, b, length, k % 4 + 1, [k], [(float(x1), float(y1)), (float(x2), float(y2))]))
    return nodes, spark.createDataFrame(rows, f"link_id long, a long, b long, length double, category int, ids array<long>, line {RING}")


def test_short_link_between_junctions_becomes_one_node(spark):
    spots = {1: (-100, 0), 2: (0, 0), 3: (8, 0), 4: (100, 0), 5: (0, 100), 6: (8, -100)}
    nodes, links = contract_short_links(*network(spark, spots, [(1, 2), (3, 4), (2, 5), (3, 6), (2, 3)]))
    assert links.count() == 4 and nodes.count() == 5
    assert [(r["x"], r["y"]) for r in nodes.where("nid = 2").collect()] == [(4.0, 0.0)]
    assert links.where("a = 2 or b = 2").count() == 4


def test_short_link_through_a_node_of_degree_two_is_joined(spark):
    spots = {1: (0, 0), 2: (90, 0), 3: (98, 0), 4: (98, 80), 5: (98, -80)}
    before = network(spark, spots, [(1, 2), (2, 3), (3, 4), (3, 5)])
    nodes, links = contract_short_links(*before)
    assert links.agg(F.sum("length")).first()[0] == before[1].agg(F.sum("length")).first()[0]
    (joined,) = links.where("size(ids) = 2").collect()
    assert joined["link_id"] == 0 and {(p["x"], p["y"]) for p in joined["line"]} == {(0.0, 0.0), (90.0, 0.0), (98.0, 0.0)}
    assert nodes.count() == 4


def test_spurs_and_triangles_stay(spark):
    spots = {1: (0, 0), 2: (50, 0), 3: (0, 50), 4: (-50, 0), 5: (5, 5), 6: (0, 8)}
    ends = [(1, 2), (1, 3), (1, 4), (1, 5), (5, 6), (6, 1), (2, 3)]
    _, links = contract_short_links(*network(spark, spots, ends))
    assert links.count() == 6  # joined once: two links between 1 and 6 are left, and joining these would close a loop
    _, links = contract_short_links(*network(spark, {1: (0, 0), 2: (50, 0), 3: (0, 50), 4: (-5, 0)}, [(1, 2), (1, 3), (2, 3), (1, 4)]))
    assert links.where("a = 4 or b = 4").count() == 1  # a short dead end


def test_width_is_that_of_the_face_across_a_link(spark):
    face = spark.createDataFrame([(1, box(0, -8, 200, 8)), (2, box(50, 6, 70, 20)), (3, box(0, 500, 10, 510))], f"face_id long, ring {RING}")
    links = spark.createDataFrame([(1, 0, 0, 200, 0), (2, 1000, 1000, 1100, 1000), (3, 100, -3, 100, 3)], "link_id long, x1 long, y1 long, x2 long, y2 long")
    got = {r["link_id"]: r["width_m"] for r in P.road_widths(links, face).collect()}
    assert got[1] == pytest.approx(16.0) and 2 not in got and got[3] == pytest.approx(80.0)


def test_junction_faces_are_small_and_hold_a_node(spark):
    face = spark.createDataFrame([(0, box(-10, -10, 10, 10)), (1, box(10, -8, 300, 8)), (2, box(-2000, -2000, 2000, 2000))], f"face_id long, ring {RING}")
    nodes = spark.createDataFrame([(7, 0.0, 0.0)], "nid long, x double, y double")
    assert [r[0] for r in P.junction_faces(face, nodes).collect()] == [0]
    assert [tuple(r) for r in P.touching_face(face, nodes).collect()] == [(7, 0)]


@pytest.mark.parametrize("state", ["1", "3"])
def test_a_junction_of_two_carriageways_is_merged_on_the_ground_only(spark, state):
    spots = {1: (0, 3), 2: (0, -3), 10: (-100, 3), 11: (100, 3), 20: (-100, -3), 21: (100, -3), 30: (0, 100), 40: (0, -100)}
    nodes, links = network(spark, spots, [(1, 2), (10, 1), (1, 11), (20, 2), (2, 21), (30, 1), (2, 40)])
    links = links.withColumn("state", F.when(F.col("link_id").isin(3, 4), state).otherwise("1"))
    face = spark.createDataFrame([(5, box(-10, -10, 10, 10))], f"face_id long, ring {RING}")
    merged, left = P.merge_in_faces(nodes, links, face, F.col("state").isin("2", "3"), F.lit("0"))
    if state == "1":
        assert sorted((r["nid"], r["node"], r["x"], r["y"]) for r in merged.collect()) == [(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0)]
        assert left.count() == 6 and left.where("a = 1 or b = 1").count() == 6
    else:
        assert [r["nid"] for r in merged.collect()] == [1] and left.count() == 7


def test_overlap_of_bent_rings():
    triangle = box(0, 0, 10, 10)[:3]
    assert box_overlap(triangle, (0, 0), (10, 10)) == pytest.approx(50)
    assert box_overlap(triangle, (0, 0), (5, 5)) == pytest.approx(12.5)
    assert box_overlap(triangle, (20, 20), (30, 30)) == 0
    notched = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]
    whole = sum(box_overlap(notched, (i, j), (i + 1, j + 1)) for i in range(10) for j in range(10))
    assert whole == pytest.approx(box_overlap(notched, (0, 0), (10, 10))) == pytest.approx(60)


def test_values_go_to_cells_by_area(spark):
    areas = spark.createDataFrame([(1, 6, box(-100, 0, 200, 100)), (2, 5, box(0, 0, 0, 10))], f"area_id long, value int, ring {RING}")
    got = {(r["cx"], r["cy"]): r["value"] for r in P.areal_interpolation(areas, 100.0).collect()}
    assert got == {(-1, 0): 2.0, (0, 0): 2.0, (1, 0): 2.0}


def test_inner_vertices_meet_ground_nodes(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0), (200.0, 0.0)])], f"link_id long, line {RING}")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.3, 0.3), (3, 100.4, 0.4)], "nid long, x double, y double")
    assert [r["nid"] for r in T.interior_contacts(lines, nodes).collect()] == [2]


def graph(spark, pairs, block):
    ids = sorted({n for p in pairs for n in p})
    return spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(n, block(n)) for n in ids], "node long, block long"), ids


@pytest.mark.parametrize("block", [lambda n: n % 3, lambda n: n // 4])
def test_exit_paths_and_components_equal_plain_walks(spark, block):
    pairs = [(n, n + 1) for n in range(11)] + [(3, 0), (7, 4), (5, 20), (20, 21), (30, 31), (31, 32), (32, 30), (2, 9)]
    edges, nodes, ids = graph(spark, pairs, block)
    then, before = {n: [] for n in ids}, {n: [] for n in ids}
    for a, b in pairs:
        then[a].append(b)
        before[b].append(a)

    def walk(starts, arcs):
        dist, queue = dict.fromkeys(starts, 0), deque(starts)
        while queue:
            n = queue.popleft()
            for m in arcs[n]:
                if m not in dist:
                    dist[m] = dist[n] + 1
                    queue.append(m)
        return dist

    exits = [n for n in ids if not then[n]]
    far = walk(exits, before)
    paths = {r["node"]: r["path"] for r in R.exit_paths(edges, nodes).collect()}
    assert set(paths) == set(ids)
    for n, path in paths.items():
        assert len(path) == far.get(n, 0)
        for a, b in zip([n, *path], path, strict=False):
            assert b in then[a]
    main = {r["node"] for r in R.largest_scc(edges, nodes).collect()}
    sets = [{m for m in ids if m in walk([n], then) and n in walk([m], then)} for n in ids]
    assert len(main) == max(map(len, sets)) and main in sets
    reach = {r["node"]: (r["from_entry"], r["to_exit"]) for r in R.entry_exit_reach(edges, nodes, nodes.where("node = 5")).collect()}
    assert reach == {n: (n in walk([5], then), n in far) for n in ids}
