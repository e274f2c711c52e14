"""Steps whose memory, shuffles or tasks must not grow faster than their input."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import crossings as V
from roadloom.functions import geo as G
from roadloom.operators import spatial_join as S
from roadloom.operators.graph import connected_components, near_stars
from roadloom.plans import registry, topology
from roadloom.sources import zips
from roadloom.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def spots(spark, n: int, seed: int):
    """Points with copies of places, repeated rows and a null."""
    pick = random.Random(seed)
    rows = [(i, float(pick.randint(-40, 40)), float(pick.randint(-40, 40))) for i in range(n)]
    rows += rows[:5] + [(n + i, x, y) for i, (_, x, y) in enumerate(rows[:20])] + [(n + 50, None, 1.0)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def close(rows, tol):
    return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and None not in a + b and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= tol * tol}


def test_distance_pairs_are_all_pairs_and_never_broadcast(spark):
    rows, points = spots(spark, 150, 1)
    for tol in (1.0, 4.0, 7.5):
        pairs = S.distance_pairs(points, tol)
        assert "Broadcast" not in plan(pairs)
        found = [tuple(r) for r in pairs.collect()]
        assert len(found) == len(set(found)) and set(found) == close(rows, tol)


def test_stars_join_what_all_pairs_join(spark):
    rows, points = spots(spark, 120, 2)
    limits = (1.0, 3.0, 5.0)
    stars = near_stars(S.near_links(points, 5.0), [S.cell(F.col(c), 16.0) for c in ("x", "y")], limits, "dist").collect()
    for limit in limits:
        own = [(r["src"], r["dst"]) for r in stars if r["limit"] == limit]
        pairs = list(close(rows, limit))
        want, got = (connected_components(spark.createDataFrame(e, "src long, dst long")).collect() for e in (pairs, own))
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        assert len(own) < len(pairs)


def test_points_go_to_four_cells_and_meet_all_places_in_reach(spark):
    rows, points = spots(spark, 150, 4)
    for reach in (1.0, 4.0, 7.5):
        spread = S.around(points.select(F.col("id").alias("ida"), "x", "y"), "x", "y", reach)
        assert spread.count() <= 4 * len(rows)
        other = S.in_cells(points.select(F.col("id").alias("idb"), F.col("x").alias("xb"), F.col("y").alias("yb")), "xb", "yb", reach)
        far = (F.col("x") - F.col("xb")) ** 2 + (F.col("y") - F.col("yb")) ** 2
        found = spread.join(other, ["cx", "cy"]).where((F.col("ida") < F.col("idb")) & (far <= reach * reach))
        assert {tuple(r) for r in found.select("ida", "idb").collect()} == close(rows, reach)


def test_any_within_makes_no_pairs(spark):
    assert "SortMergeJoin [cx" in (text := plan(registry.queries()["e10_has_any_within"](spark, SF))) and "LeftSemi" in text and "Broadcast" not in text


def test_sensors_are_never_broadcast_and_links_are_made_twice(spark):
    text = plan(registry.queries()["e22_sensor_cascade"](spark, SF))
    assert "Broadcast" not in text and text.count("part.parquet") == 8


@pytest.mark.parametrize("name", ["e10_has_any_within", "e12_zone_edges", "e22_sensor_cascade"])
def test_nine_cells_a_row_are_never_broadcast(spark, name):
    assert "BroadcastHashJoin [cx" not in plan(registry.queries()[name](spark, SF))


def test_contacts_of_every_bend_with_nodes_and_signs(spark):
    lines = topology.bent_crossings(view(spark, SF, "fx_links"))
    assert {r["n"] for r in lines.select(F.size("line").alias("n")).collect()} == {28}
    bends = lines.limit(1).select("link_id", F.explode(F.slice("line", 2, 26)).alias("v")).select("link_id", F.monotonically_increasing_id().alias("nid"), "v.x", "v.y").localCheckpoint()
    found = topology.interior_contacts(lines.join(bends.select("link_id").distinct(), "link_id"), bends.drop("link_id"))
    assert found.count() == 26
    assert "kind" in registry.queries()["j07_interior_contacts"](spark, SF).columns


def test_parts_in_rings_and_widths_agree_with_the_column_functions(spark):
    pick = random.Random(3)
    rows = []
    for i in range(300):
        spots = [(pick.uniform(-9, 9), pick.uniform(-9, 9)) for _ in range(pick.randint(3, 7))]
        rows.append((i, *(pick.uniform(-12, 12) for _ in range(4)), [*spots, spots[0]]))
    df = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double, ring array<struct<x: double, y: double>>")
    parts = G.inside_intervals(*(F.col(c) for c in ("ax", "ay", "bx", "by")), F.col("ring"))
    want = {(r["id"], round(r["i"]["a"], 9), round(r["i"]["b"], 9)) for r in df.select("id", F.explode(parts).alias("i")).collect()}
    batch = df.toArrow().combine_chunks().to_batches()[0]
    row, a, b = V.inside_parts(*(batch.column(c).to_numpy() for c in ("ax", "ay", "bx", "by")), *V.vertices(batch.column("ring")))
    assert len(want) > 100 and {(int(i), round(p, 9), round(q, 9)) for i, p, q in zip(row, a, b, strict=True)} == want
    own, width = V.union_widths(*(np.array(c) for c in ([4, 4, 4, 4, 7, 9], [0, 0, 0, 1, 0, 0], [0.4, 0.1, 0.8, 0.45, 0.0, 0.5], [0.6, 0.4, 0.9, 0.55, 0.2, 0.75])), 0.01, 1e-9)
    assert own.tolist() == [4, 9] and [round(w, 9) for w in width] == [0.3, 0.25]


def test_widths_are_worked_on_by_batches(spark):
    assert plan(registry.queries()["e15_road_widths"](spark, SF)).count("MapInArrow") >= 3


def test_position_lists_are_read_once_and_in_all_tasks(spark):
    text = plan(registry.queries()["a08_position_lists"](spark, SF))
    assert "RoundRobinPartitioning" in text and text.count("split(") == 1


def test_zip_members_are_as_many_as_tasks_and_batches_end_by_their_size(spark, tmp_path):
    spark.range(6).select(F.repeat(F.lit("x"), F.lit(1_500_000)).alias("note")).coalesce(1).withColumn("key", F.lit("k")).transform(lambda df: zips.write_zips(df, str(tmp_path), "m") or df)
    reader = zips.ZipReader({"path": str(tmp_path), "columns": "key,note"})
    (member,) = reader.partitions()
    assert [b.num_rows for b in reader.read(member)] == [3, 3]
    found = registry.queries()["a04_zip_members"](spark, SF)
    assert found.rdd.getNumPartitions() > 3


def test_both_passes_come_from_one_meeting(spark):
    text = plan(registry.queries()["e08_two_pass_attach"](spark, SF))
    assert len(re.findall("Join \\[level", text)) == 1
