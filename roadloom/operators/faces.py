"""Road faces: rings that hold nodes, widths across them, values spread by area."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from roadloom.functions import crossings as V
from roadloom.functions import geo as G
from roadloom.operators.spatial_join import cell

#: The largest face of a junction, the disc round a node, and the probes of a width.
JUNCTION_MAX_M2, TOUCH_M, STEP_M, MARGIN_M, HALF_M, NEAR_M = 5000.0, 1.0, 10.0, 8.0, 40.0, 0.5
CELL_M = 160.0


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(cell(low, CELL_M), cell(high, CELL_M)))


def _bounds(ring: Column) -> list[Column]:
    side = lambda pick, axis: pick(F.transform(ring, lambda p: p[axis]))
    return [side(F.array_min, "x").alias("_x1"), side(F.array_min, "y").alias("_y1"), side(F.array_max, "x").alias("_x2"), side(F.array_max, "y").alias("_y2")]


def spread_faces(faces: DataFrame, reach: float = 0.0, bounds: bool = False) -> DataFrame:
    """A row of ``faces`` (face_id, ring, ...) for each cell that its box, wider by ``reach``, touches; with the box as _x1,
    _y1, _x2, _y2 if ``bounds``."""
    boxed = faces.select("*", *_bounds(F.col("ring")))
    rows = boxed.withColumn("cx", _cells(F.col("_x1") - reach, F.col("_x2") + reach)).withColumn("cy", _cells(F.col("_y1") - reach, F.col("_y2") + reach))
    return rows if bounds else rows.drop("_x1", "_y1", "_x2", "_y2")


def junction_faces(faces: DataFrame, nodes: DataFrame, max_area: float = JUNCTION_MAX_M2) -> DataFrame:
    """(face_id) of faces (face_id, ring) of at most ``max_area`` that hold one of nodes (nid, x, y). Faces too large go
    before they are spread."""
    small = spread_faces(faces.where(G.ring_area(F.col("ring")) <= max_area))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    placed = nodes.select("x", "y", cell(x, CELL_M).alias("cx"), cell(y, CELL_M).alias("cy"))
    return small.join(placed, ["cx", "cy"]).where(G.in_ring(x, y, F.col("ring"))).select("face_id").distinct()


def touching_face(faces: DataFrame, nodes: DataFrame, reach: float = TOUCH_M) -> DataFrame:
    """(nid, face_id): the smallest of faces (face_id, ring) that a disc round each of nodes (nid, x, y) touches; of equal
    areas the smaller face_id. Nodes that touch none get no row."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    placed = nodes.select("nid", "x", "y", cell(x, CELL_M).alias("cx"), cell(y, CELL_M).alias("cy"))
    both = spread_faces(faces.withColumn("area", G.ring_area(F.col("ring"))), reach).join(placed, ["cx", "cy"])
    near = both.where(G.in_ring(x, y, F.col("ring")) | (G.ring_distance(x, y, F.col("ring")) <= reach))
    return near.groupBy("nid").agg(F.min(F.struct("area", "face_id")).alias("m")).select("nid", F.col("m.face_id").alias("face_id"))


def merge_in_faces(nodes: DataFrame, links: DataFrame, faces: DataFrame, separated: Column, layer: Column) -> tuple[DataFrame, DataFrame]:
    """(merged nodes, links): junctions in one face become one node.

    Nodes (nid, x, y) take part whose links (link_id, a, b, ...), three at least, are all on the ground (``separated`` is
    false) and in one layer. The smallest nid of a face stands for all, at their centroid: (nid, node, x, y, face_id) for
    every node that has a face. Links get the new ends, and those between two nodes of a face go.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("nid"), separated.alias("high"), layer.alias("layer"))
    fit = ends.groupBy("nid").agg(F.count("*").alias("n"), F.bool_or("high").alias("high"), F.min("layer").alias("l1"), F.max("layer").alias("l2")).where("n >= 3 and not high and l1 = l2")
    own = touching_face(faces, nodes.join(fit.select("nid"), "nid", "left_semi"))
    placed = nodes.select("nid", "x", "y").join(own, "nid")
    each = placed.groupBy("face_id").agg(F.min("nid").alias("node"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    merged = own.join(each, "face_id").select("nid", "node", "x", "y", "face_id")
    new = lambda end: merged.select(F.col("nid").alias(end), F.col("node").alias(f"_{end}"))
    moved = links.join(new("a"), "a", "left").join(new("b"), "b", "left").where("_a is null or _b is null or _a <> _b")
    others = [c for c in links.columns if c not in ("a", "b")]
    return merged, moved.select(*others, F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))


def probes(links: DataFrame) -> DataFrame:
    """(link_id, k, px, py, ax, ay, bx, by): places along links (link_id, line), or straight ones (link_id, x1, y1, x2, y2),
    away from both ends, and the line across each. Distances are along the line, and a place on a bend is crossed at right
    angles to the chord of a metre each way. A short link has one place, its middle; lines without length have none."""
    line = F.col("line") if "line" in links.columns else F.array(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2")))
    names = ("k", "px", "py", "dx", "dy", "chord")
    kind = dict(links.dtypes)["link_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, at = V.vertices(batch.column("line"))
            rows = [V.line_probes(x[i:j], y[i:j], STEP_M, MARGIN_M) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            ids = batch.column("link_id").take(pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows])))
            values = np.concatenate(rows) if rows else np.empty((0, len(names)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(values[:, 0].astype(np.int32)), *(pa.array(values[:, i]) for i in range(1, len(names)))], names=["link_id", *names])

    schema = f"link_id {kind}, k int, px double, py double, dx double, dy double, chord double"
    rows = links.select("link_id", line.alias("line")).where("line is not null").mapInArrow(run, schema)
    off = lambda side: (F.col("px") - side * HALF_M * F.col("dy") / F.col("chord"), F.col("py") + side * HALF_M * F.col("dx") / F.col("chord"))
    (ax, ay), (bx, by) = off(-1), off(1)
    return rows.select("link_id", "k", "px", "py", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def road_widths(links: DataFrame, faces: DataFrame) -> DataFrame:
    """(link_id, width_m): the median over a link's probes of the length, across it, of the faces' union that holds the
    probe. Probes outside all faces do not count; links without any have no row. A probe and a face meet in the first cell
    that both have, if their boxes touch, so no pair comes twice and rings are not moved again. A probe meets the faces
    near it only, so the intervals of a link are in proportion to its length. Lines, rings and intervals are worked on a
    batch at a time."""
    pick = {"lx": F.least("ax", "bx"), "ly": F.least("ay", "by"), "hx": F.greatest("ax", "bx"), "hy": F.greatest("ay", "by")}
    across = probes(links).withColumns(pick)
    spread = across.withColumn("cx", _cells(F.col("lx"), F.col("hx"))).withColumn("cy", _cells(F.col("ly"), F.col("hy")))
    own = spread_faces(faces.select("face_id", "ring"), bounds=True)
    first = (F.col("cx") == cell(F.greatest("lx", "_x1"), CELL_M)) & (F.col("cy") == cell(F.greatest("ly", "_y1"), CELL_M))
    both = spread.join(own, ["cx", "cy"]).where(first & F.expr("lx <= _x2 and hx >= _x1 and ly <= _y2 and hy >= _y1"))
    kind = dict(links.dtypes)["link_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b = V.inside_parts(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")), *V.vertices(batch.column("ring")))
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("link_id").take(own), batch.column("k").take(own), pa.array(a), pa.array(b)], names=["link_id", "k", "a", "b"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("own")
            parts = lists.flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            own, width = V.union_widths(row, *(parts.field(c).to_numpy(zero_copy_only=False) for c in ("k", "a", "b")), NEAR_M / (2 * HALF_M), 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("link_id").take(pa.array(own)), pa.array(width * 2 * HALF_M)], names=["link_id", "width_m"])

    parts = both.select("link_id", "k", "ax", "ay", "bx", "by", "ring").mapInArrow(cut, f"link_id {kind}, k int, a double, b double")
    lists = parts.groupBy("link_id").agg(F.collect_list(F.struct("k", "a", "b")).alias("own"))
    return lists.mapInArrow(measure, f"link_id {kind}, width_m double")


def boundary_edges(areas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x1, y1, x2, y2): the edges of rings of areas (keys, ring) that only one side of a key's areas has, with the
    inside to their left. An edge that two rings of a key share has one of each direction, and these cancel. Neighbours
    must share the vertices of their border; rings may run either way and need not be closed by a repeated vertex."""
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    signed = F.aggregate(G.segments(closed), F.lit(0.0), lambda a, s: a + s["x1"] * s["y2"] - s["x2"] * s["y1"])
    rows = areas.where(F.size("ring") >= 3).select(*keys, F.explode(G.segments(F.when(signed < 0, F.reverse(closed)).otherwise(closed))).alias("s")).select(*keys, "s.*")
    rows = rows.where("x1 <> x2 or y1 <> y2")
    forward = F.expr("x1 < x2 or (x1 = x2 and y1 < y2)")
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    net = rows.select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(forward, 1).otherwise(-1).alias("way")).groupBy(*keys, "a", "b").agg(F.sum("way").alias("way"))
    first, last = F.when(F.col("way") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("way") > 0, F.col("b")).otherwise(F.col("a"))
    return net.where("way <> 0").select(*keys, first.alias("p"), last.alias("q")).select(*keys, F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def rings_of(edges: list[tuple[tuple[float, float], tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings of directed edges that end where others begin. Where two rings meet in a point the sharpest turn to the
    left is taken, so that they stay two; vertices on a straight line go."""
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for a, b in sorted(edges):
        after.setdefault(a, []).append(b)

    def turn(a, b, c):
        return math.atan2((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]), (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]))

    rings = []
    for start in sorted(after):
        while after.get(start):
            ring = [start, after[start].pop()]
            while ring[-1] != start:
                out = after[ring[-1]]
                out.sort(key=lambda c: turn(ring[-2], ring[-1], c))  # noqa: B023
                ring.append(out.pop())
            bent = [p for i, p in enumerate(ring[:-1]) if abs(turn(ring[i - 1] if i else ring[-2], p, ring[i + 1])) > 1e-12]
            rings.append([*bent, bent[0]])
    return rings


def dissolve(areas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rings): the union of areas (keys, ring) of each key, which must not overlap. Outer rings run against the clock,
    holes with it. Borders between areas of a key are gone before anything is gathered; what is left of a key is one row
    of the result, so it is put together in one task. Areas of fewer than three vertices have no part in it."""
    kinds = dict(areas.dtypes)
    edges = boundary_edges(areas, keys)

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = [list(zip(pdf[x].tolist(), pdf[y].tolist(), strict=True)) for x, y in (("x1", "y1"), ("x2", "y2"))]
        rings = [[{"x": x, "y": y} for x, y in ring] for ring in rings_of(list(zip(*points, strict=True)))]
        return pd.DataFrame([[*key, rings]], columns=[*keys, "rings"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", rings array<array<struct<x: double, y: double>>>"
    return edges.groupBy(*keys).applyInPandas(chain, schema)


def areal_interpolation(areas: DataFrame, size: float) -> DataFrame:
    """(cx, cy, value): the values of areas (area_id, value, ring) given to square cells of a side ``size`` by the share of
    each area that lies in a cell. An area meets the cells of its box; areas without area give nothing."""
    boxed = areas.select("area_id", "value", "ring", G.ring_area(F.col("ring")).alias("whole"), *_bounds(F.col("ring"))).where("whole > 0")
    rows = boxed.withColumn("cx", F.explode(F.sequence(cell(F.col("_x1"), size), cell(F.col("_x2"), size))))
    rows = rows.withColumn("cy", F.explode(F.sequence(cell(F.col("_y1"), size), cell(F.col("_y2"), size))))
    shares = rows.withColumn("part", _overlap("ring", "cx", "cy", F.lit(float(size)))).where("part > 0")
    return shares.groupBy("cx", "cy").agg(F.sum(F.col("value") * F.col("part") / F.col("whole")).alias("value"))


@arrow_udf(DoubleType())
def _overlap(ring: pa.Array, cx: pa.Array, cy: pa.Array, size: pa.Array) -> pa.Array:
    """Area of each ring within the cell that its indexes name."""
    out = []
    for points, i, j, side in zip(*(a.to_pylist() for a in (ring, cx, cy, size)), strict=True):
        out.append(G.box_overlap([(p["x"], p["y"]) for p in points], (i * side, j * side), ((i + 1) * side, (j + 1) * side)))
    return pa.array(out, pa.float64())
