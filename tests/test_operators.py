"""Literal cases of the operators, a few rows each."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import geo as G
from roadloom.functions import mesh as M
from roadloom.functions import text as T
from roadloom.functions.stats import fit_from_sums, geh, sums
from roadloom.operators import network as N
from roadloom.operators import spatial_join as S
from roadloom.operators.graph import connected_components
from roadloom.plans import cascades, network, registry


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_snapping_within_half_a_metre(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.3, 0.0), (3, 5.0, 0.0), (4, 5.2, 0.2)], "id int, x double, y double")
    pairs = S.distance_pairs(points, 0.5)
    comps = connected_components(pairs.select(F.col("id1").alias("src"), F.col("id2").alias("dst"))).collect()
    assert {(r["node"], r["component"]) for r in comps} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_components_of_a_long_path_and_a_hub(spark):
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    hub = spark.range(1000, 1300).select(F.lit(5000).cast("long").alias("src"), F.col("id").alias("dst"))
    loop = spark.createDataFrame([(9000, 9000), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(path.union(hub).union(loop)).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1300)) and got[5000] == 1000 and got[9000] == 9000


def test_nearest_node_and_miss(spark):
    nodes = spark.createDataFrame([(10, 0.0, 0.0), (20, 100.0, 0.0)], "nid int, x double, y double")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 128.0, -3.0), (3, 60.0, 60.0)], "pid int, px double, py double")
    assert {r["pid"]: r["nid"] for r in S.nearest_within(points, nodes, 30.0).collect()} == {1: 10, 2: 20, 3: None}


def test_line_match_by_direction_distance_and_cover(spark):
    link = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], "link_id int, x1 double, y1 double, x2 double, y2 double")
    regs = [(1, 0.0, 5.0, 100.0, 5.0), (2, 100.0, 5.0, 0.0, 5.0), (3, 50.0, -50.0, 50.0, 50.0), (4, 0.0, 30.0, 100.0, 30.0), (5, 0.0, 4.0, 30.0, 4.0)]
    schema = "reg_id int, x1 double, y1 double, x2 double, y2 double"
    assert {r["reg_id"]: r["dots"] > 0 for r in S.line_match(link, spark.createDataFrame(regs, schema), 15.0).collect()} == {1: True, 2: False, 5: True}
    assert S.best_match(S.line_match(link, spark.createDataFrame(regs[4:], schema), 15.0)).count() == 0


def test_metrics_and_geh(spark):
    df = spark.createDataFrame([(110, 100), (190, 200), (410, 400)], "s int, o int").select(F.col("s").cast("decimal(18,3)"), F.col("o").cast("decimal(18,3)"))
    row = df.agg(*sums(F.col("s"), F.col("o"))).select(*[c.alias(k) for k, c in fit_from_sums().items()]).first()
    assert row["r"] > 0.99 and row["ratio"] == 1.014
    same = spark.createDataFrame([(1, 5), (2, 5)], "s int, o int").select(F.col("s").cast("decimal(18,3)"), F.col("o").cast("decimal(18,3)"))
    assert same.agg(*sums(F.col("s"), F.col("o"))).select(fit_from_sums()["r"].alias("r")).first()["r"] is None
    g = one(spark, geh(F.lit(1100.0), F.lit(1000.0)).alias("a"), geh(F.lit(0.0), F.lit(0.0)).alias("b"))
    assert round(g["a"], 2) == 3.09 and g["b"] == 0


def test_lanes_round_halves_to_even_and_guard(spark):
    rows = spark.createDataFrame([(8, True), (5, True), (5, False), (None, True)], "census int, two boolean")
    lanes, source = N.lanes(F.col("census"), F.col("two"), F.lit(None).cast("double"), F.lit(4))
    assert [tuple(r) for r in rows.select(lanes, source).collect()] == [(4, "census"), (2, "census"), (3, "class"), (2, "class")]


def test_turn_shares_without_the_way_back(spark):
    edges = spark.createDataFrame(
        [(1, 0, 1, 2, 0.0, 0.0, 0.0, 100.0), (2, 1, 0, 1, 0.0, 100.0, 0.0, 0.0), (3, 1, 2, None, 0.0, 100.0, 0.0, 200.0), (4, 1, 3, None, 0.0, 100.0, -100.0, 100.0), (5, 1, 4, None, 0.0, 100.0, 100.0, 100.0)],
        "eid int, frm int, to int, linked_edge int, x1 double, y1 double, x2 double, y2 double",
    )
    got = {r["succ"]: round(r["p"], 6) for r in N.turn_probabilities(edges).where("eid = 1").collect()}
    assert got == {3: 0.70, 4: 0.15, 5: 0.15}


def test_names_numbers_and_points(spark):
    row = one(
        spark, T.travel_direction(F.lit("北７西２７ 東西")).alias("d"), *[c.alias(k) for k, c in T.grid_address(F.lit("北７西２７")).items()], T.base_id(F.lit("5.-60")).alias("b"), T.base_id(F.lit("x.1")).alias("n"),
        T.kanji_number(F.lit("二十一")).alias("k"), F.size(T.parse_points(F.lit("141.0 43.0;x y;10 43"))).alias("p"), F.size(T.parse_points(F.lit(None).cast("string"))).alias("q"),
    )
    assert (row["d"], row["ns"], row["n"], row["ew"], row["m"], row["b"], row["n"], row["k"], row["p"], row["q"])[:2] == ("西", "北")
    assert (row["m"], row["b"], row["k"], row["p"], row["q"]) == (27, 5, 21, 1, 0)


def test_mesh_code(spark):
    ix, iy = M.mesh6_index(F.lit(141.071875), F.lit(42.66666666666667))
    assert one(spark, M.mesh6_code(ix, iy).alias("c"))["c"] == "64410005221"


def test_polygon_and_angles(spark):
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0))])
    row = one(spark, G.in_ring(F.lit(5.0), F.lit(5.0), ring).alias("a"), G.in_ring(F.lit(15.0), F.lit(5.0), ring).alias("b"), G.ring_area(ring).alias("c"), G.ring_distance(F.lit(5.0), F.lit(12.0), ring).alias("d"), G.angle_diff(F.lit(350.0), F.lit(10.0)).alias("e"), G.undirected_diff(F.lit(179.0), F.lit(1.0)).alias("f"))
    assert tuple(row) == (True, False, 100.0, 2.0, -20.0, 2.0)


def test_components_and_acceptance_of_all_links(spark, monkeypatch):
    links = [(1, 2, 2), (2, 4, 2), (4, 5, 1), (10, 11, 2), (11, 13, 1), (20, 20, 2), (30, 31, 1), (31, 32, 2)]
    up = {n: n for a, b, _ in links for n in (a, b)}

    def find(n):
        return n if up[n] == n else find(up[n])

    for a, b, _ in links:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    size = {r: sum(find(n) == r for n in up) for r in up}
    tables = {"fx_links": spark.createDataFrame(links, "a long, b long, category int"), "fx_nodes": spark.createDataFrame([(n, -1e9, 0.0) for n in up], "nid long, x double, y double")}
    for module in (network, cascades):
        monkeypatch.setattr(module, "view", lambda spark, sf_dir, name: tables[name])
    got = {r["nid"]: (r["component"], r["size"], r["is_main"]) for r in registry.queries()["j08_whole_components"](spark, "").collect()}
    assert got == {n: (find(n), size[find(n)], find(n) == 1) for n in up}
    row = registry.queries()["j09_whole_acceptance"](spark, "").first()
    assert (row["nodes"], row["main_nodes"], row["components"], row["boundary"], row["boundary_in_main"], row["dead_ends"]) == (len(up), 4, 4, len(up), False, 0)
