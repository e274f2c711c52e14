"""Measured polylines: matches along bends and over parts, probes that stand on bends."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo as G
from roadloom.operators import faces as P
from roadloom.operators import spatial_join as S

PARTS = "array<array<struct<x:double,y:double>>>"


def rows(spark, key, found):
    return spark.createDataFrame(found, f"{key} int, parts {PARTS}")


def best(spark, links, features, buffer=15.0):
    got = S.best_match(S.line_match(rows(spark, "link_id", links), rows(spark, "reg_id", features), buffer))
    return {r.link_id: (r.reg_id, r.sign) for r in got.collect()}


def test_cover_is_of_the_whole_length_of_a_bent_link(spark):
    corner = [[(0.0, 0.0), (60.0, 0.0), (60.0, 80.0)]]
    half = [[(2.0, 4.0), (58.0, 4.0)]]  # 56 of 140 m, nearly all of the first segment
    most = [[(56.0, 4.0), (56.0, 80.0)]]  # 76 of 140 m
    both = [[(56.0, 78.0), (56.0, 4.0), (2.0, 4.0)]]
    assert best(spark, [(1, corner)], [(1, half)]) == {}
    assert best(spark, [(1, corner)], [(1, half), (2, most)]) == {1: (2, 1)}
    assert best(spark, [(1, corner)], [(1, half), (2, most), (3, both)]) == {1: (3, -1)}
    cover = S.line_match(rows(spark, "link_id", [(1, corner)]), rows(spark, "reg_id", [(3, both)]), 15.0).first()
    assert (cover["cover"], cover["dots"], cover["len"]) == (pytest.approx(54 + 74), pytest.approx(-128), pytest.approx(140))


def test_every_part_of_a_feature_counts(spark):
    feature = [[(0.0, 0.0), (90.0, 0.0)], [(210.0, 0.0), (260.0, 0.0), (400.0, 0.0)]]
    assert best(spark, [(1, [[(220.0, -3.0), (395.0, -3.0)]])], [(5, feature)]) == {1: (5, 1)}
    assert best(spark, [(1, [[(395.0, -3.0), (220.0, -3.0)]])], [(5, feature)]) == {1: (5, -1)}
    assert best(spark, [(1, [[(100.0, 3.0), (200.0, 3.0)]])], [(5, feature)]) == {}  # in the gap


def test_links_of_many_parts_long_features_and_lines_without_length(spark):
    long = [[(-900.0, 0.0), (900.0, 0.0)]]
    links = [(1, [[(640.0, 6.0), (700.0, 6.0)], [(710.0, 6.0), (760.0, 6.0)]]), (2, [[(5.0, 5.0), (5.0, 5.0)]]), (3, []), (4, None), (5, [[(0.0, -40.0), (0.0, 40.0)]])]
    assert best(spark, links, [(7, long), (8, [[(1.0, 1.0)]]), (9, None)]) == {1: (7, 1)}
    assert best(spark, [], [(7, long)]) == best(spark, links, []) == {}


def test_points_along_a_measured_line(spark):
    line = [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (3.0, 10.0)]
    df = spark.createDataFrame([(line, d) for d in (-1.0, 0.0, 2.5, 5.0, 8.0, 11.0, 99.0)] + [([(1.0, 1.0)], 0.0), ([], 0.0)], "line array<struct<x:double,y:double>>, d double")
    segs = G.measured(F.col("line"))
    got = df.select(G.measured_length(segs).alias("n"), G.at_distance(segs, F.col("d")).alias("p")).collect()
    assert [r.n for r in got] == [11.0] * 7 + [0.0, 0.0]
    want = [(0, 0), (0, 0), (1.5, 2), (3, 4), (3, 7), (3, 10), (3, 10)]
    assert all(math.dist(r.p, w) < 1e-9 for r, w in zip(got[:7], want, strict=True))
    assert [r.p for r in got[7:]] in ([None, None], [(None, None)] * 2)


def box(x1, y1, x2, y2):
    return [(float(x), float(y)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]


def test_probes_follow_a_bend(spark):
    links = spark.createDataFrame([(1, [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0)]), (2, [(0.0, 300.0), (4.0, 300.0)]), (3, [(9.0, 9.0)])], "link_id int, line array<struct<x:double,y:double>>")
    got = {(r.link_id, r.k): r for r in P.probes(links).collect()}
    assert sorted(got) == [(1, k) for k in range(8)] + [(2, 0)]
    assert (got[1, 0].px, got[1, 0].py) == (pytest.approx(13.25), 0.0) and (got[2, 0].px, got[2, 0].ay) == (2.0, pytest.approx(260.0))
    last = got[1, 7]
    assert (last.px, last.py) == (50.0, pytest.approx(36.75)) and abs(last.ax - last.bx) == pytest.approx(80.0)


def test_width_along_a_bend_is_the_median_of_all_probes(spark):
    links = spark.createDataFrame([(1, [(0.0, 0.0), (40.0, 0.0), (40.0, 90.0)]), (2, [(500.0, 500.0), (540.0, 500.0)])], "link_id int, line array<struct<x:double,y:double>>")
    faces = spark.createDataFrame([(1, box(-10, -5, 34, 7)), (2, box(33, 8, 51, 200)), (3, box(-500, -5, -200, 7)), (4, box(31, 8, 35, 200))], "face_id int, ring array<struct<x:double,y:double>>")
    got = {r.link_id: r.width_m for r in P.road_widths(links, faces).collect()}
    assert got == {1: pytest.approx(20.0)}
