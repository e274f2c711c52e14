"""Column functions on points, lines and rings. A line is array<struct<x double, y double>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def segments(line: Column) -> Column:
    """array<struct<x1, y1, x2, y2>> of a line's segments; empty for fewer than two vertices."""
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.when(F.size(line) >= 2, pairs).otherwise(F.slice(pairs, 1, 0))


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda a, s: a + hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]))


def directed_segments(line: Column, least: float = 1e-9) -> Column:
    """array<struct<mx, my, ux, uy, len>>: middle, unit vector and length; segments shorter than ``least`` are left out."""
    own = F.transform(segments(line), lambda s: F.struct(((s["x1"] + s["x2"]) / 2).alias("mx"), ((s["y1"] + s["y2"]) / 2).alias("my"), (s["x2"] - s["x1"]).alias("dx"), (s["y2"] - s["y1"]).alias("dy"), hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]).alias("len")))
    return F.transform(F.filter(own, lambda s: s["len"] >= least), lambda s: F.struct(s["mx"], s["my"], (s["dx"] / s["len"]).alias("ux"), (s["dy"] / s["len"]).alias("uy"), s["len"]))


def measured(line: Column) -> Column:
    """array<struct<x1, y1, x2, y2, len, d>>: the segments with any length and how far along the line each begins."""
    own = F.transform(segments(line), lambda s: F.struct(s["x1"], s["y1"], s["x2"], s["y2"], hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]).alias("len")))
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double,len:double,d:double>>"
    step = lambda a, s: F.struct(
        (a["d"] + s["len"]).alias("d"), F.concat(a["out"], F.array(F.struct(s["x1"], s["y1"], s["x2"], s["y2"], s["len"], a["d"].alias("d")))).alias("out")
    )
    start = F.struct(F.lit(0.0).alias("d"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.filter(own, lambda s: s["len"] > 1e-9), start, step, lambda a: a["out"])


def measured_length(segs: Column) -> Column:
    """The length of a line of measured segments; 0 without any."""
    last = F.element_at(segs, -1)
    return F.when(F.size(segs) > 0, last["d"] + last["len"]).otherwise(F.lit(0.0))


def at_distance(segs: Column, d: Column) -> Column:
    """struct<x, y>: the point ``d`` along a line of measured segments, its ends for a ``d`` beyond them; null without any."""
    own = F.coalesce(F.try_element_at(F.filter(segs, lambda s: s["d"] <= d), F.lit(-1)), F.get(segs, 0))
    return F.transform(F.array(own), lambda s: F.transform(F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - s["d"]) / s["len"]))), lambda t: point(s["x1"] + t * (s["x2"] - s["x1"]), s["y1"] + t * (s["y2"] - s["y1"])))[0])[0]


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """Signed difference a - b in (-180, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def undirected_diff(a: Column, b: Column) -> Column:
    """Difference of two axes in [0, 90]."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180 - d)


def to_grid(x: Column, y: Column, degrees: float, x0: float, y0: float) -> tuple[Column, Column]:
    """(u, v): rotated by ``degrees`` about (x0, y0)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (x - x0) * c + (y - y0) * s, (y - y0) * c - (x - x0) * s


def from_grid(u: Column, v: Column, degrees: float, x0: float, y0: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return u * c - v * s + x0, u * s + v * c + y0


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Perpendicular inside the span, else to the nearer end; to the point itself for a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return hypot(ex, ey)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test against a closed ring."""
    crossings = F.aggregate(
        segments(ring),
        F.lit(0),
        lambda a, s: a + F.when(((s["y1"] > py) != (s["y2"] > py)) & (px < (s["x2"] - s["x1"]) * (py - s["y1"]) / F.when(s["y2"] != s["y1"], s["y2"] - s["y1"]).otherwise(F.lit(1.0)) + s["x1"]), 1).otherwise(0),
    )
    return crossings % 2 == 1


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    return F.array_min(F.transform(segments(ring), lambda s: point_segment_distance(px, py, s["x1"], s["y1"], s["x2"], s["y2"])))


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(segments(ring), F.lit(0.0), lambda a, s: a + (s["x1"] * s["y2"] - s["x2"] * s["y1"]))) / 2


def midpoint(line: Column) -> Column:
    """The point halfway along a line; null for fewer than two vertices."""
    half = line_length(line) / 2
    walked = F.aggregate(
        segments(line),
        F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")),
        lambda a, s: F.struct(
            (a["run"] + hypot(s["x2"] - s["x1"], s["y2"] - s["y1"])).alias("run"),
            F.when(a["x"].isNotNull(), a["x"]).when(a["run"] + hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]) >= half, s["x1"] + (s["x2"] - s["x1"]) * F.try_divide(half - a["run"], hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]))).alias("x"),
            F.when(a["y"].isNotNull(), a["y"]).when(a["run"] + hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]) >= half, s["y1"] + (s["y2"] - s["y1"]) * F.try_divide(half - a["run"], hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]))).alias("y"),
        ),
    )
    return F.struct(walked["x"].alias("x"), walked["y"].alias("y"))


def inside_intervals(x1: Column, y1: Column, x2: Column, y2: Column, ring: Column) -> Column:
    """array<struct<a, b>>: the parts of a straight line inside a ring, in shares of its length: the line is cut at all
    crossings and pieces are kept by their middle."""
    dx, dy = x2 - x1, y2 - y1

    def crossing(s: Column) -> Column:
        ex, ey = s["x2"] - s["x1"], s["y2"] - s["y1"]
        det = dx * ey - dy * ex
        t = F.try_divide((s["x1"] - x1) * ey - (s["y1"] - y1) * ex, det)
        u = F.try_divide((s["x1"] - x1) * dy - (s["y1"] - y1) * dx, det)
        return F.when(t.between(0, 1) & u.between(0, 1), t)

    crossings = F.filter(F.transform(segments(ring), crossing), lambda t: t.isNotNull())
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings))
    pairs = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mid = lambda p: (p["a"] + p["b"]) / 2
    return F.filter(pairs, lambda p: (p["b"] > p["a"]) & in_ring(x1 + mid(p) * dx, y1 + mid(p) * dy, ring))


def clipped_length(x1: Column, y1: Column, x2: Column, y2: Column, ring: Column) -> Column:
    """Length of the part of a straight line inside a ring."""
    kept = F.aggregate(inside_intervals(x1, y1, x2, y2, ring), F.lit(0.0), lambda acc, p: acc + p["b"] - p["a"])
    return kept * hypot(x2 - x1, y2 - y1)


def box_overlap(points: list[tuple[float, float]], low: tuple[float, float], high: tuple[float, float]) -> float:
    """Area of the part of a ring, of any shape, inside a box: the ring is cut along the box's four sides in turn. Cut-off
    parts may leave seams along a side, which have no area."""
    for axis in (0, 1):
        for bound, sign in ((low[axis], 1), (high[axis], -1)):
            kept = []
            for p, q in zip(points, points[1:] + points[:1], strict=True):
                p_in, q_in = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
                if p_in:
                    kept.append(p)
                if p_in != q_in:
                    t = (bound - p[axis]) / (q[axis] - p[axis])
                    kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            points = kept
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))) / 2


def far_ends(points: Column) -> Column:
    """struct<d, x1, y1, x2, y2> of the two points farthest apart; of equal distances the largest coordinates."""
    pairs = F.flatten(F.transform(points, lambda a: F.transform(points, lambda b: F.struct(hypot(a["x"] - b["x"], a["y"] - b["y"]).alias("d"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))))
    return F.array_max(pairs)


def join_lines(first: Column, second: Column, at: Column) -> Column:
    """Two lines that meet near ``at`` as one: the first turned to end there, the second to start there."""
    far = lambda p: hypot(p["x"] - at["x"], p["y"] - at["y"])
    a = F.when(far(F.element_at(first, -1)) <= far(F.element_at(first, 1)), first).otherwise(F.reverse(first))
    b = F.when(far(F.element_at(second, 1)) <= far(F.element_at(second, -1)), second).otherwise(F.reverse(second))
    return F.concat(a, F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))))


#: Semi-major axis and inverse flattening of GRS 80, scale on the central meridian.
AXIS_M, FLATTENING, SCALE = 6378137.0, 1 / 298.257222101, 0.9999


def _series() -> tuple[float, list[float], list[float], float]:
    n = FLATTENING / (2 - FLATTENING)
    to = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return n, to, back, SCALE * AXIS_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def _conformal(phi: Column, n: float) -> Column:
    """Sine of an angle to the tangent of the conformal latitude."""
    e = 2 * math.sqrt(n) / (1 + n)
    return F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))


def project(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """(east, north) metres of the transverse Mercator plane about (lon0, lat0), by the fourth-order series."""
    n, to, _, radius = _series()
    phi0 = math.radians(lat0)
    e = 2 * math.sqrt(n) / (1 + n)
    xi0 = math.atan(math.sinh(math.atanh(math.sin(phi0)) - e * math.atanh(e * math.sin(phi0))))
    origin = radius * (xi0 + sum(a * math.sin(2 * k * xi0) for k, a in enumerate(to, 1)))
    tau, lam = _conformal(F.radians(lat), n), F.radians(lon - lon0)
    xi = F.atan2(tau, F.cos(lam))
    eta = F.asinh(F.sin(lam) / hypot(tau, F.cos(lam)))
    north, east = xi, eta
    for k, a in enumerate(to, 1):
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return east * radius, north * radius - origin


def unproject(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """(lon, lat) of plane metres; the inverse of ``project``."""
    n, to, back, radius = _series()
    phi0 = math.radians(lat0)
    e = 2 * math.sqrt(n) / (1 + n)
    xi0 = math.atan(math.sinh(math.atanh(math.sin(phi0)) - e * math.atanh(e * math.sin(phi0))))
    origin = radius * (xi0 + sum(a * math.sin(2 * k * xi0) for k, a in enumerate(to, 1)))
    xi, eta = (y + origin) / radius, x / radius
    xi1, eta1 = xi, eta
    for k, b in enumerate(back, 1):
        xi1 = xi1 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta1 = eta1 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lift = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    phi = chi
    for k, d in enumerate(lift, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + lon0, F.degrees(phi)
