"""Joins by distance, as equi-joins on grid cells with an exact test afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import hypot, measured, point, point_segment_distance


#: Reaches are taken a little longer where rows go to cells, since sums and distances are rounded.
SLACK = 1.001


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def in_cells(df: DataFrame, x: str, y: str, reach: float) -> DataFrame:
    """The cell of each point, as ``cx`` and ``cy``, among those that ``around`` gives for this reach."""
    side = 2.0 * (SLACK * reach)
    return df.withColumn("cx", cell(F.col(x), side)).withColumn("cy", cell(F.col(y), side))


def around(df: DataFrame, x: str, y: str, reach: float) -> DataFrame:
    """A row for each cell that holds places at most ``reach`` from the point on both axes, as ``cx`` and ``cy``.

    Cells are as wide as the span from one end of the reach to the other, so these are four. Spark takes the four rows for
    the size of one, so a join would hand them whole through the driver to all executors; the hint has it sort and merge,
    where adaptive execution splits a crowded cell.
    """
    wide = SLACK * reach
    span = lambda c: F.sequence(cell(F.col(c) - wide, 2.0 * wide), cell(F.col(c) + wide, 2.0 * wide))
    return df.withColumn("cx", F.explode(span(x))).withColumn("cy", F.explode(span(y))).hint("merge")


def nearest_within(points: DataFrame, nodes: DataFrame, tol: float) -> DataFrame:
    """points (pid, px, py) with ``nid`` and ``dist`` of the nearest of nodes (nid, x, y) within ``tol``, else nulls.

    Ties go to the smaller nid. Points are spread over cells and the minimum is combined before the shuffle.
    """
    spread = around(points.select("pid", "px", "py"), "px", "py", tol)
    own = in_cells(nodes.select("nid", "x", "y"), "x", "y", tol)
    near = spread.join(own, ["cx", "cy"]).withColumn("dist", hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).where(F.col("dist") <= tol)
    best = near.groupBy("pid").agg(F.min(F.struct("dist", "nid")).alias("b"))
    return points.join(best, "pid", "left").select(*[points[c] for c in points.columns], F.col("b.nid").alias("nid"), F.col("b.dist").alias("dist"))


def near_pairs(points: DataFrame, tol: float) -> DataFrame:
    """(id1, id2, dist, x, y), id1 < id2, of points (id, x, y) at most ``tol`` apart, with the place of one of them. A row
    for each pair of rows, so repeated ids give repeated pairs.

    Cells have twice the tolerance as their side. A point goes to its own cell and to those of the cells east, north-west,
    north and north-east that it is near enough to, so two points meet in one cell only.
    """
    side, reach = 2.0 * tol, 1.001 * tol  # a little more, since sums are rounded
    x, y = F.col("x"), F.col("y")
    cx, cy = cell(x, side), cell(y, side)
    east, west, north = cell(x + reach, side) > cx, cell(x - reach, side) < cx, cell(y + reach, side) > cy
    at = lambda i, j, when: F.when(when, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")))
    steps = F.array_compact(F.array(at(0, 0, F.lit(True)), at(1, 0, east), at(-1, 1, west & north), at(0, 1, north), at(1, 1, east & north)))
    left = points.select(F.col("id").alias("ida"), x, y, cx.alias("cx"), cy.alias("cy"), F.explode(steps).alias("s"))
    left = left.select("ida", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), F.expr("s.i = 0 and s.j = 0").alias("own")).hint("merge")
    right = points.select(F.col("id").alias("idb"), x.alias("xb"), y.alias("yb"), cx.alias("cx"), cy.alias("cy"))
    both = left.join(right, ["cx", "cy"]).where("if(own, ida < idb, ida <> idb)").withColumn("dist", hypot(x - F.col("xb"), y - F.col("yb")))
    return both.where(F.col("dist") <= tol).select(F.least("ida", "idb").alias("id1"), F.greatest("ida", "idb").alias("id2"), "dist", "x", "y")


def distance_pairs(points: DataFrame, tol: float) -> DataFrame:
    """(id1, id2), id1 < id2, of points (id, x, y) at most ``tol`` apart."""
    return near_pairs(points, tol).select("id1", "id2").distinct()


def near_links(points: DataFrame, tol: float) -> DataFrame:
    """(src, dst, dist, x, y): links between points (id, x, y) that join the same points as all pairs at most any tolerance
    up to ``tol`` apart would. Points of one place link to its smallest id, and only these meet those of other places."""
    first = points.groupBy("x", "y").agg(F.min("id").alias("id"))
    copies = points.join(first.withColumnRenamed("id", "rep"), ["x", "y"]).where("id <> rep")
    same = copies.select(F.col("rep").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"), "x", "y")
    return near_pairs(first, tol).select(F.col("id1").alias("src"), F.col("id2").alias("dst"), "dist", "x", "y").unionByName(same)


def nearest_incident(points: DataFrame, links: DataFrame) -> DataFrame:
    """For points (pid, px, py, nid) the nearest of links (link_id, a, b, x1, y1, x2, y2) that meet their node."""
    ends = links.withColumn("nid", F.explode(F.array("a", "b")))
    d = point_segment_distance(*(F.col(c).cast("double") for c in ("px", "py", "x1", "y1", "x2", "y2")))
    return points.join(ends, "nid").groupBy("pid").agg(F.min(F.struct(d.alias("dist"), F.col("link_id"))).alias("b")).select("pid", F.col("b.link_id").alias("link_id"), F.col("b.dist").alias("dist"))


def match_segments(df: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2, ux, uy, len, total): the directed segments of rows with polylines ``parts`` (array of lines), or
    with one straight line x1, y1, x2, y2, and the length of all segments of the row."""
    if "parts" not in df.columns:
        df = df.select(key, F.array(F.array(point(F.col("x1"), F.col("y1")), point(F.col("x2"), F.col("y2")))).alias("parts"))
    segs = F.flatten(F.transform("parts", measured))
    rows = df.select(key, segs.alias("segs")).withColumn("total", F.aggregate("segs", F.lit(0.0), lambda a, s: a + s["len"]))
    rows = rows.select(key, "total", F.explode("segs").alias("s")).select(key, "total", "s.x1", "s.y1", "s.x2", "s.y2", "s.len")
    return rows.withColumn("ux", (F.col("x2") - F.col("x1")) / F.col("len")).withColumn("uy", (F.col("y2") - F.col("y1")) / F.col("len"))


def line_match(links: DataFrame, features: DataFrame, buffer: float, dot_min: float = 0.85, near: float | None = None) -> DataFrame:
    """(link_id, reg_id, cover, dots, len) of links and features, both with polylines ``parts`` or straight (x1, y1, x2, y2).

    A feature's segment covers a link's where they are near parallel, the feature's middle is within ``buffer`` of the
    link's line, and their spans overlap along it. Cover is summed over all segments of the link and all parts of the
    feature, and ``len`` is the link's whole length, that of segments without cover included. Each link segment goes to
    all cells that its box touches, widened by a cell, each feature segment to the cell of its middle, so the equi-join
    loses no pair. The cells have a side of eight buffers, doubled for features too long for it, so that a long feature
    widens the search for its own length class alone. With ``near``, a narrower buffer, there are also ``near_cover`` and
    ``near_dots`` of what lies within that, null where nothing does.
    """
    size = buffer * 8
    seg = match_segments(links, "link_id")
    reg = match_segments(features, "reg_id")
    reg = reg.select("reg_id", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"), F.col("ux").alias("vx"), F.col("uy").alias("vy"), F.col("len").alias("rlen"))
    # A feature's middle may lie up to half its length before or after the link, so the link's box grows by that much. Each
    # feature has the least level whose cells are no smaller, and a link meets the features of a level in cells of that level.
    need = F.col("rlen") / 2 + buffer
    reg = reg.withColumn("level", F.greatest(F.ceil(F.log2(need / size)), F.lit(0)).cast("int"))
    # The levels there are come along in one row, at most one for each doubling of the length.
    levels = reg.agg(F.collect_set("level").alias("levels"))
    seg = seg.join(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels")
    side = F.pow(F.lit(2.0), F.col("level")) * size
    at = lambda v: F.floor(v / side).cast("long")
    span = lambda a, b: F.sequence(at(F.least(a, b) - side), at(F.greatest(a, b) + side))
    seg = seg.withColumn("cx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"))))
    reg = reg.withColumn("cx", at(F.col("mx"))).withColumn("cy", at(F.col("my")))
    both = seg.join(reg, ["level", "cx", "cy"]).withColumn("dot", F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy"))
    both = both.withColumn("along", (F.col("mx") - F.col("x1")) * F.col("ux") + (F.col("my") - F.col("y1")) * F.col("uy"))
    both = both.withColumn("off", F.abs((F.col("mx") - F.col("x1")) * F.col("uy") - (F.col("my") - F.col("y1")) * F.col("ux")))
    overlap = F.least(F.col("len"), F.col("along") + F.col("rlen") / 2) - F.greatest(F.lit(0.0), F.col("along") - F.col("rlen") / 2)
    found = both.withColumn("overlap", overlap).where((F.abs("dot") >= dot_min) & (F.col("off") <= buffer) & (F.col("overlap") > 0))
    sums = [F.sum("overlap").alias("cover"), F.sum(F.col("dot") * F.col("overlap")).alias("dots"), F.max("total").alias("len")]
    if near is not None:
        inner = F.when(F.col("off") <= near, F.col("overlap"))
        sums += [F.sum(inner).alias("near_cover"), F.sum(F.col("dot") * inner).alias("near_dots")]
    return found.groupBy("link_id", "reg_id").agg(*sums)


def best_match(matches: DataFrame, cover_min: float = 0.5) -> DataFrame:
    """(link_id, reg_id, sign): the feature of most cover, if it covers enough of the link; ties to the smaller reg_id."""
    best = matches.groupBy("link_id").agg(F.min(F.struct((-F.col("cover")).alias("c"), F.col("reg_id"), F.col("dots"), F.col("len"))).alias("b"))
    good = best.where(-F.col("b.c") >= cover_min * F.col("b.len"))
    return good.select("link_id", F.col("b.reg_id").alias("reg_id"), F.when(F.col("b.dots") > 0, 1).otherwise(-1).alias("sign"))


def near_line_pairs(points: DataFrame, lines: DataFrame, tol: float, size: float) -> DataFrame:
    """Rows of points (pid, px, py, ...) with rows of straight lines (lid, x1, y1, x2, y2, ...) at most ``tol`` away, and
    ``dist``. A line goes to all cells of side ``size`` that its box, wider by ``tol``, touches; a point to its own."""
    span = lambda a, b: F.sequence(cell(F.least(a, b) - tol, size), cell(F.greatest(a, b) + tol, size))
    spread = lines.withColumn("cx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"))))
    own = points.withColumn("cx", cell(F.col("px"), size)).withColumn("cy", cell(F.col("py"), size))
    d = point_segment_distance(*(F.col(c).cast("double") for c in ("px", "py", "x1", "y1", "x2", "y2")))
    return own.join(spread, ["cx", "cy"]).withColumn("dist", d).where(F.col("dist") <= tol).drop("cx", "cy")
