"""Directed edges, lanes, speeds, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import angle_diff, bearing

#: Widths per lane and their factors, caps, the guard, and the shares of turns.
SUBLANE_M, CLASS_LANE_M, CLASS_FACTOR, MEASURED_LANE_M, MEASURED_FACTOR = 1.75, 3.0, 0.7, 4.25, 0.68
CAP_NARROW, CAP_WIDE, GUARD_LANES = 3, 4, 5
TURN_SHARES = {"straight": 0.70, "left": 0.15, "right": 0.15}
CLASS_WIDTH = {1: 3.0, 2: 5.5, 3: 9.0, 4: 13.0, 5: 19.5}


def directed_edges(links: DataFrame) -> DataFrame:
    """Two rows for a two-way link, one for a one-way link, in travel order. eid is twice the link's id, plus one against
    the vertex order; linked_edge is the opposite edge or null; source tells how the direction is known."""
    forward = F.struct(F.lit(0).alias("dir"), F.col("a").alias("frm"), F.col("b").alias("to"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    back = F.struct(F.lit(1).alias("dir"), F.col("b").alias("frm"), F.col("a").alias("to"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    ways = F.when(F.col("oneway") == "F", F.array(forward)).when(F.col("oneway") == "R", F.array(back)).otherwise(F.array(forward, back))
    rows = links.withColumn("w", F.explode(ways))
    eid = F.col("link_id") * 2 + F.col("w.dir")
    return rows.select(
        eid.alias("eid"), "w.frm", "w.to", F.when(F.col("oneway") == "", F.col("link_id") * 2 + 1 - F.col("w.dir")).alias("linked_edge"),
        F.when(F.col("oneway") == "", "two_way").otherwise("regulation").alias("source"), "link_id", "width_cls", "category", "state", "w.x1", "w.y1", "w.x2", "w.y2",
    )


def lanes(census_lanes: Column, two_way: Column, measured_m: Column, width_cls: Column) -> tuple[Column, Column]:
    """(lanes, source): census, then measured width, then width class; halves round to even."""
    share = F.when(two_way, 0.5).otherwise(1.0)
    census = F.bround(census_lanes * share, 0).cast("int")
    one_way_m = F.when(two_way, measured_m / 2).otherwise(measured_m)
    measured = F.least(F.greatest(F.bround(one_way_m * MEASURED_FACTOR / MEASURED_LANE_M, 0).cast("int"), F.lit(1)), F.lit(CAP_WIDE))
    width = F.coalesce(F.create_map(*[F.lit(v) for kv in CLASS_WIDTH.items() for v in kv])[width_cls], F.lit(5.5))
    by_class = F.least(F.greatest(F.bround(F.when(two_way, width / 2).otherwise(width) * CLASS_FACTOR / CLASS_LANE_M, 0).cast("int"), F.lit(1)), F.lit(CAP_NARROW))
    usable = census_lanes.isNotNull() & (census < GUARD_LANES) & (census >= 1)
    return F.when(usable, census).when(measured_m.isNotNull(), measured).otherwise(by_class), F.when(usable, "census").when(measured_m.isNotNull(), "measured").otherwise("class")


def sublanes(width_m: Column) -> Column:
    return F.greatest(F.floor(width_m / SUBLANE_M).cast("int"), F.lit(1))


def speed(regulated: Column, census: Column, category: Column, width_cls: Column) -> tuple[Column, Column]:
    """(km/h, source): regulation, census, municipal roads (class 4) by width, class default."""
    value = F.coalesce(regulated, census, F.when(category == 4, F.when(width_cls <= 2, 30).otherwise(50)), F.when(category.isin(1, 2), 50).otherwise(40))
    source = F.when(regulated.isNotNull(), "regulation").when(census.isNotNull(), "census").when(category == 4, "width").otherwise("class")
    return value.cast("int"), source


def turn_probabilities(edges: DataFrame) -> DataFrame:
    """(eid, succ, turn, p): successors but the way back, by bearing; the classes present share 1 by their weights, and
    within a class by 1 / (1 + deviation)^2. If only sharp returns are left, the smallest successor gets 1."""
    a = edges.select("eid", "to", "linked_edge", bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("b1"))
    b = edges.select(F.col("eid").alias("succ"), F.col("frm").alias("to"), bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("b2"))
    d = angle_diff(F.col("b2"), F.col("b1"))
    pairs = a.join(b, "to").where("linked_edge is null or succ <> linked_edge").withColumn("d", F.bround(d, 6))
    turn = F.when(F.abs("d") <= 45, "straight").when(F.abs("d") >= 135, "sharp").when(F.col("d") < 0, "left").otherwise("right")
    centre = F.when(F.col("turn") == "straight", 0.0).when(F.col("turn") == "left", -90.0).otherwise(90.0)
    pairs = pairs.withColumn("turn", turn).withColumn("w", 1 / ((1 + F.abs(F.col("d") - centre)) * (1 + F.abs(F.col("d") - centre))))
    # An edge has a handful of successors, so these windows are small whatever the network.
    own, kind = Window.partitionBy("eid"), Window.partitionBy("eid", "turn")
    good = pairs.where("turn <> 'sharp'").withColumn("rank", F.row_number().over(kind.orderBy("succ")))
    share = F.create_map(*[F.lit(v) for kv in TURN_SHARES.items() for v in kv])[F.col("turn")]
    good = good.withColumn("share", share).withColumn("total", F.sum(F.when(F.col("rank") == 1, F.col("share"))).over(own)).withColumn("p", F.col("share") / F.col("total") * F.col("w") / F.sum("w").over(kind))
    only = pairs.join(good.select("eid").distinct(), "eid", "left_anti").groupBy("eid").agg(F.min("succ").alias("succ")).select("eid", "succ", F.lit("sharp").alias("turn"), F.lit(1.0).alias("p"))
    return good.select("eid", "succ", "turn", "p").union(only)


def degree1_nodes(edges: DataFrame) -> DataFrame:
    """(nid) of nodes with one undirected edge; the two directions of a link count once."""
    pairs = edges.select(F.least("eid", F.coalesce("linked_edge", "eid")).alias("pair"), F.explode(F.array("frm", "to")).alias("nid")).distinct()
    return pairs.groupBy("nid").agg(F.count("*").alias("n")).where("n = 1").select("nid")
