"""Geometry and mesh functions over derived links and points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo as G
from roadloom.functions import mesh as M
from roadloom.functions.stats import dec
from roadloom.plans.registry import query
from roadloom.plans.validation import dec_sql
from roadloom.sources.fixtures import view

_LINE_SQL = "line as (select *, x1 + (x2 - x1) * 0.5 + link_id % 7 - 3 as mx, y1 + (y2 - y1) * 0.5 + link_id % 5 - 2 as my from fx_links)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as lines of three vertices."""
    links = view(spark, sf_dir, "fx_links")
    mx = F.col("x1") + (F.col("x2") - F.col("x1")) * 0.5 + F.col("link_id") % 7 - 3
    my = F.col("y1") + (F.col("y2") - F.col("y1")) * 0.5 + F.col("link_id") % 5 - 2
    return links.withColumn("line", F.array(G.point(F.col("x1"), F.col("y1")), G.point(mx, my), G.point(F.col("x2"), F.col("y2"))))


_L1, _L2 = "sqrt((mx - x1) * (mx - x1) + (my - y1) * (my - y1))", "sqrt((x2 - mx) * (x2 - mx) + (y2 - my) * (y2 - my))"


@query(f"with {_LINE_SQL} select link_id, {dec_sql(f'{_L1} + {_L2}')} as length_m from line")
def c01_line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("link_id", dec(G.line_length(F.col("line"))).alias("length_m"))


@query(f"""with {_LINE_SQL}, s as (select link_id, 0 as seg, x1 as ax, y1 as ay, mx as bx, my as by_ from line union all select link_id, 1, mx, my, x2, y2 from line),
d as (select *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) as len from s)
select link_id, seg, {dec_sql('(ax + bx) / 2')} as mx, {dec_sql('(ay + by_) / 2')} as my, {dec_sql('(bx - ax) / len')} as ux, {dec_sql('(by_ - ay) / len')} as uy, {dec_sql('len')} as len from d where len > 1e-9""")
def c02_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("link_id", F.posexplode(G.directed_segments(F.col("line"))).alias("seg", "s"))
    return rows.select("link_id", "seg", *[dec(F.col(f"s.{c}")).alias(c) for c in ("mx", "my", "ux", "uy", "len")])


_B = "degrees(atan2(cast(x2 - x1 as double), cast(y2 - y1 as double)))"
_B2 = "cast(link_id * 37 % 360 as double)"


def _pm(x: str, m: float) -> str:
    return f"((({x}) % {m} + {m}) % {m})"


_D = _pm(f"{_B} - {_B2}", 360.0)
_U = _pm(f"{_B} - {_B2}", 180.0)


@query(f"select link_id, {dec_sql(_pm(_B, 360.0))} as bearing, {dec_sql(f'case when {_D} > 180 then {_D} - 360 else {_D} end')} as signed, {dec_sql(f'least({_U}, 180 - {_U})')} as axis from fx_links")
def c03_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.bearing((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double"))
    raw = F.degrees(F.atan2((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")))
    other = (F.col("link_id") * 37 % 360).cast("double")
    return view(spark, sf_dir, "fx_links").select("link_id", dec(b).alias("bearing"), dec(G.angle_diff(raw, other)).alias("signed"), dec(G.undirected_diff(raw, other)).alias("axis"))


_DEG, _X0, _Y0 = -10.906, 1000.0, 500.0
_C, _S = math.cos(math.radians(_DEG)), math.sin(math.radians(_DEG))


@query(f"select nid, {dec_sql(f'(x - {_X0}) * {_C!r} + (y - {_Y0}) * {_S!r}')} as u, {dec_sql(f'(y - {_Y0}) * {_C!r} - (x - {_X0}) * {_S!r}')} as v, true as back from fx_nodes")
def c05_grid_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "fx_nodes")
    u, v = G.to_grid(F.col("x"), F.col("y"), _DEG, _X0, _Y0)
    x, y = G.from_grid(u, v, _DEG, _X0, _Y0)
    return nodes.select("nid", dec(u).alias("u"), dec(v).alias("v"), ((F.abs(x - F.col("x")) < 1e-6) & (F.abs(y - F.col("y")) < 1e-6)).alias("back"))


@query(f"""with u as (select link_id, (x2 - x1) * {_C!r} + (y2 - y1) * {_S!r} as du, (y2 - y1) * {_C!r} - (x2 - x1) * {_S!r} as dv from fx_links)
select link_id, {dec_sql(_pm('degrees(atan2(du, dv))', 360.0))} as bearing from u""")
def c04_grid_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return view(spark, sf_dir, "fx_links").select("link_id", dec(G.bearing(dx * _C + dy * _S, dy * _C - dx * _S)).alias("bearing"))


_RING = ((900.0, 100.0), (2900.0, 350.0), (2500.0, 2300.0), (1400.0, 1500.0), (700.0, 1900.0), (900.0, 100.0))


def _ring_column():
    return F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in _RING])


def _ring_segments() -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(_RING, _RING[1:], strict=False)]


_IN_SQL = " + ".join(f"case when ({y1} > y) <> ({y2} > y) and x < ({x2} - {x1}) * (y - {y1}) / {(y2 - y1) or 1.0} + {x1} then 1 else 0 end" for x1, y1, x2, y2 in [(a, b, c, d) for a, b, c, d in _ring_segments()])


def _dist_sql(px: str, py: str, x1, y1, x2, y2) -> str:
    t = f"greatest(0.0, least(1.0, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / (({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))))"
    ex, ey = f"({px} - ({x1} + {t} * ({x2} - {x1})))", f"({py} - ({y1} + {t} * ({y2} - {y1})))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def _d(v) -> str:
    return f"cast({v} as double)"


_RING_DIST = "least(" + ", ".join(_dist_sql("cast(x as double)", "cast(y as double)", *map(_d, s)) for s in _ring_segments()) + ")"


@query(f"select nid, ({_IN_SQL}) % 2 = 1 as inside, {dec_sql(_RING_DIST)} as boundary_m from fx_nodes")
def c08_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return view(spark, sf_dir, "fx_nodes").select("nid", G.in_ring(x, y, _ring_column()).alias("inside"), dec(G.ring_distance(x, y, _ring_column())).alias("boundary_m"))


@query(f"""select nid, x between 700 and 2900 and y between 100 and 2300 and ({_IN_SQL}) % 2 = 1 as in_region, x between 1000 and 2000 and y between 500 and 1500 as in_core from fx_nodes where x between 700 and 2900 and y between 100 and 2300""")
def b05_region_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box first, which reaches the scan; the exact test on what is left."""
    near = view(spark, sf_dir, "fx_nodes").where("x between 700 and 2900 and y between 100 and 2300")
    return near.select("nid", G.in_ring(F.col("x").cast("double"), F.col("y").cast("double"), _ring_column()).alias("in_region"), (F.col("x").between(1000, 2000) & F.col("y").between(500, 1500)).alias("in_core"))


@query(f"select link_id, {dec_sql(_dist_sql('cast(x1 + 17 as double)', 'cast(y1 + 40 as double)', *map(_d, ('x1', 'y1', 'x2', 'y2'))))} as dist from fx_links")
def c09_point_segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    dbl = lambda c: c.cast("double")
    return view(spark, sf_dir, "fx_links").select("link_id", dec(G.point_segment_distance(dbl(F.col("x1") + 17), dbl(F.col("y1") + 40), *[dbl(F.col(c)) for c in ("x1", "y1", "x2", "y2")])).alias("dist"))


@query(f"""with {_LINE_SQL}, l as (select *, {_L1} as l1, ({_L1} + {_L2}) / 2 as half, {_L2} as l2 from line)
select link_id, {dec_sql('case when l1 >= half then x1 + (mx - x1) * (half / l1) else mx + (x2 - mx) * ((half - l1) / l2) end')} as x, {dec_sql('case when l1 >= half then y1 + (my - y1) * (half / l1) else my + (y2 - my) * ((half - l1) / l2) end')} as y from l""")
def c07_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("link_id", G.midpoint(F.col("line")).alias("m")).select("link_id", dec(F.col("m.x")).alias("x"), dec(F.col("m.y")).alias("y"))


_LL = "select nid, 141.0 + x / 10000.0 as lon, 43.0 + y / 10000.0 as lat from fx_nodes"
_IX, _IY = "cast(floor((lon - 100) * 640 + 1e-9) as bigint)", "cast(floor(lat * 960 + 1e-9) as bigint)"
_CODE = """lpad(cast((iy // 8) // 80 as varchar), 2, '0') || lpad(cast((ix // 8) // 80 as varchar), 2, '0') || (iy // 80) % 8 || (ix // 80) % 8 || (iy // 8) % 10 || (ix // 8) % 10"""
_CODE6 = _CODE + " || (1 + (ix // 4) % 2 + 2 * ((iy // 4) % 2)) || (1 + (ix // 2) % 2 + 2 * ((iy // 2) % 2)) || (1 + ix % 2 + 2 * (iy % 2))"


@query(f"with ll as ({_LL}), i as (select nid, {_IX} as ix, {_IY} as iy from ll) select nid, ix, iy, {_CODE} as code8, {_CODE6} as code11, {dec_sql('ix / 640.0 + 100')} as west, {dec_sql('iy / 960.0')} as south from i")
def c17_mesh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ll = view(spark, sf_dir, "fx_nodes").select("nid", (F.lit(141.0) + F.col("x") / F.lit(10000.0)).alias("lon"), (F.lit(43.0) + F.col("y") / F.lit(10000.0)).alias("lat"))
    ix, iy = M.mesh6_index(F.col("lon"), F.col("lat"))
    rows = ll.select("nid", ix.alias("ix"), iy.alias("iy"))
    west, south, _, _ = M.mesh6_bounds(F.col("ix"), F.col("iy"))
    return rows.select("nid", "ix", "iy", M.mesh3_code(F.col("ix"), F.col("iy")).alias("code8"), M.mesh6_code(F.col("ix"), F.col("iy")).alias("code11"), dec(west).alias("west"), dec(south).alias("south"))


@query(f"""with b as (select min(x) // 130 as x0, max(x) // 130 as x1, min(y) // 130 as y0, max(y) // 130 as y1 from fx_nodes), g as (select unnest(range(x0, x1 + 1)) as ix, y0, y1 from b), c as (select ix, unnest(range(y0, y1 + 1)) as iy from g)
select ix, iy, (ix * 130 + 65 between 700 and 2900) as near from c""")
def k01_mesh_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the nodes' bounding box; the rows of the grid are made in parallel from its first column."""
    side = lambda c: F.floor(F.col(c) / 130).cast("long")
    box = view(spark, sf_dir, "fx_nodes").agg(F.min(side("x")).alias("x0"), F.max(side("x")).alias("x1"), F.min(side("y")).alias("y0"), F.max(side("y")).alias("y1"))
    cols = box.select(F.explode(F.sequence("x0", "x1")).alias("ix"), "y0", "y1").repartition("ix")
    return cols.select("ix", F.explode(F.sequence("y0", "y1")).alias("iy")).select("ix", "iy", (F.col("ix") * 130 + 65).between(700, 2900).alias("near"))


@query(f"""with {_LINE_SQL} select link_id, {dec_sql('abs((x1 * my - mx * y1) + (mx * y2 - x2 * my) + (x2 * y1 - x1 * y2)) / 2')} as area from line""")
def c15_ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.concat("line", F.slice("line", 1, 1))
    return lines(spark, sf_dir).select("link_id", dec(G.ring_area(closed)).alias("area"))


@query("select link_id, cast(greatest(2.5, 3.0 - 0.25 * (link_id % 4)) * s.scale as double) as width_m, s.name as scenario from fx_links cross join (select 'normal' as name, 1.0 as scale union all select 'winter', 0.75) s")
def c22_lane_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scenarios per link, as an explode of two literals."""
    scenes = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("scale")) for n, s in (("normal", 1.0), ("winter", 0.75))])
    rows = view(spark, sf_dir, "fx_links").select("link_id", F.explode(scenes).alias("s"))
    return rows.select("link_id", (F.greatest(F.lit(2.5), 3.0 - 0.25 * (F.col("link_id") % 4)) * F.col("s.scale")).alias("width_m"), F.col("s.name").alias("scenario"))


@query(f"select nid, {dec_sql('(x - (select min(x) from fx_nodes)) / (40.0 / 3.6)')} as offset_s from fx_nodes")
def c23_signal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "fx_nodes")
    low = nodes.agg(F.min("x").alias("low"))
    return nodes.join(F.broadcast(low)).select("nid", dec((F.col("x") - F.col("low")) / F.lit(40.0 / 3.6)).alias("offset_s"))
