"""Road tables derived from the given tables, as Spark SQL and as the same SQL for the check engine.

Integer arithmetic only, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.geo import point

NODES = """
select p_partkey as nid, (p_partkey % 50) * 130 as x, cast(floor(p_partkey / 50) as bigint) * 130 as y,
  p_size % 5 + 1 as width_cls, p_size % 4 + 1 as category from part
"""
LINKS = """
select a.nid * 2 as link_id, a.nid as a, b.nid as b, a.x as x1, a.y as y1, b.x as x2, b.y as y2, a.width_cls as width_cls, a.category as category,
  case when a.nid % 97 = 0 then '3' else '1' end as state, case when a.nid % 11 = 0 then 'F' when a.nid % 13 = 0 then 'R' else '' end as oneway
from fx_nodes a join fx_nodes b on b.nid = a.nid + 1 and a.nid % 50 < 49
union all
select a.nid * 2 + 1, a.nid, b.nid, a.x, a.y, b.x, b.y, b.width_cls, b.category,
  case when a.nid % 89 = 0 then '2' else '1' end, case when a.nid % 17 = 0 then 'F' else '' end
from fx_nodes a join fx_nodes b on b.nid = a.nid + 50 where a.nid % 7 <> 3
"""
SIGNS = """
select o_orderkey as sign_id, (o_custkey % 50) * 130 + o_orderkey % 61 - 30 as x,
  cast(floor(o_custkey / 50) as bigint) * 130 + o_orderkey % 53 - 26 as y,
  case when o_orderstatus = 'F' then '98' when o_orderstatus = 'O' then '63' else '11' end as code from orders
"""
SENSOR = "select user_id as det, ts, cast(floor(value) as bigint) as volume from events"
OBS = """
select o.o_custkey as eid, case when c.c_nationkey % 2 = 0 then 'census' else 'detector' end as source, 'U' || cast(c.c_nationkey as varchar(10)) as unit,
  case when o.o_custkey % 2 = 0 then 'up' else 'down' end as direction, o.o_orderkey % 24 as hour, sum(cast(floor(o.o_totalprice) as bigint)) as cnt
from orders o join customer c on c.c_custkey = o.o_custkey group by 1, 2, 3, 4, 5
"""
FLOW = """
select o.o_custkey as eid, o.o_orderkey % 24 as hour, sum(cast(floor(l.l_extendedprice) as bigint)) as flow
from lineitem l join orders o on o.o_orderkey = l.l_orderkey group by 1, 2
"""
REGLINES = """
select link_id as reg_id, case when link_id % 2 = 0 then x1 else x2 end as x1, case when link_id % 2 = 0 then y1 + 5 else y2 + 5 end as y1,
  case when link_id % 2 = 0 then x2 else x1 end as x2, case when link_id % 2 = 0 then y2 + 5 else y1 + 5 end as y2,
  30 + 10 * (link_id % 4) as speed from fx_links where link_id % 5 = 0
"""
FACES = """
select nid as face_id, case when nid % 23 = 0 then x - 10 else x - 4 - nid % 41 end as fx1, case when nid % 23 = 0 then x + 140 else x + 4 + nid % 41 end as fx2,
  case when nid % 23 = 0 then y - 10 else y - 4 - nid % 37 end as fy1, case when nid % 23 = 0 then y + 10 else y + 4 + nid % 37 end as fy2 from fx_nodes
"""
ROADS = """
select link_id as road_id, case when y1 = y2 then x1 else x1 - 4 - width_cls end as rx1, case when y1 = y2 then x2 else x1 + 3 + 2 * width_cls end as rx2,
  case when y1 = y2 then y1 - 4 - width_cls else y1 end as ry1, case when y1 = y2 then y1 + 3 + 2 * width_cls else y2 end as ry2 from fx_links where link_id % 6 <> 5
"""
def _segments_sql(table: str, key: str, where: str, lines: list[tuple[int, str, list[tuple[str, str]]]], end: str = "") -> str:
    """A row (key, part, k, x1, y1, x2, y2) for each segment of lines given as places (along, across) of straight links."""
    place = lambda p: f"x1 + case when y1 = y2 then {p[0]} else {p[1]} end, y1 + case when y1 = y2 then {p[1]} else {p[0]} end"
    rows = []
    for part, cond, line in lines:
        for k, (a, b) in enumerate(zip(line, line[1:], strict=False)):
            for flip in (False, True) if end else (False,):
                own = f"{place(b)}, {place(a)}" if flip else f"{place(a)}, {place(b)}"
                names = iter(own.split(", "))
                cols = ", ".join(f"{next(names)} as {c}" for c in ("sx1", "sy1", "sx2", "sy2"))
                test = [where, cond, (end if flip else f"not ({end})") if end else ""]
                rows.append(f"select link_id as {key}, {part} as part, {k} as k, {cols} from {table} where {' and '.join(x for x in test if x) or 'true'}")
    return " union all ".join(rows)


#: Links with two bends, and regulation lines along a fifth of them, of two parts or the first alone, half of them against
#: the link: places along and across the straight link, in metres.
LINK_BENDS = [("0", "0"), ("40", "link_id % 5 * 2"), ("90", "(link_id % 7 - 3)"), ("130", "0")]
REG_PARTS = [(0, "", [("0", "5"), ("20", "6"), ("45", "9")]), (1, "link_id % 15 <> 0", [("60", "6"), ("130", "4")])]
BENT = _segments_sql("fx_links", "link_id", "", [(0, "", LINK_BENDS)])
REGBENT = _segments_sql("fx_links", "reg_id", "link_id % 5 = 0", REG_PARTS, end="link_id % 2 = 1")


VIEWS = {"fx_nodes": NODES, "fx_links": LINKS, "fx_signs": SIGNS, "fx_sensor": SENSOR, "fx_obs": OBS, "fx_flow": FLOW, "fx_reglines": REGLINES, "fx_faces": FACES, "fx_roads": ROADS, "fx_bent": BENT, "fx_regbent": REGBENT}
_BELOW = {"fx_links": ["fx_nodes"], "fx_reglines": ["fx_nodes", "fx_links"], "fx_faces": ["fx_nodes"], "fx_roads": ["fx_nodes", "fx_links"], "fx_bent": ["fx_nodes", "fx_links"], "fx_regbent": ["fx_nodes", "fx_links"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; the given tables come in as named arguments, so no view is left in the session."""
    own = {t: table(spark, sf_dir, t) for t in ("part", "orders", "customer", "lineitem", "events")}
    sql = VIEWS[name].replace("fx_nodes", "{fx_nodes}").replace("fx_links", "{fx_links}")
    need = {}
    for below in _BELOW.get(name, []):
        # Links are made in all tasks: nodes broadcast to the few tasks that read the table would leave the rest to these.
        need[below] = view(spark, sf_dir, below).hint("merge")
    for t, df in own.items():
        pattern = f" {t}"
        if f"from {t}" in sql or f"join {t}" in sql:
            sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
            need[t] = df
    return spark.sql(sql, **{k: v for k, v in need.items() if f"{{{k}}}" in sql})


def with_views(sql: str) -> str:
    """The check engine's SQL with the derived tables that it names in front."""
    names: list[str] = []
    for name in VIEWS:
        if name in sql:
            names += [*_BELOW.get(name, []), name]
    names = list(dict.fromkeys(names))
    if not names:
        return sql
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"with recursive {head}, {body[5:].removeprefix('recursive ')}" if body.lower().startswith("with ") else f"with {head} {body}"


def _line(places: list[tuple[str, str]]) -> Column:
    flat = F.col("y1") == F.col("y2")
    at = lambda a, b: F.when(flat, F.expr(a)).otherwise(F.expr(b))
    return F.array(*[point(F.col("x1") + at(a, b), F.col("y1") + at(b, a)) for a, b in places])


def bent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_links with ``line`` and ``parts``, the polyline whose segments fx_bent has."""
    return view(spark, sf_dir, "fx_links").withColumn("line", _line(LINK_BENDS)).withColumn("parts", F.array("line"))


def bent_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reg_id, parts): the polylines whose segments fx_regbent has."""
    rows = view(spark, sf_dir, "fx_links").where("link_id % 5 = 0")
    against = F.col("link_id") % 2 == 1
    parts = [F.when(F.expr(cond or "true"), F.when(against, F.reverse(_line(line))).otherwise(_line(line))) for _, cond, line in REG_PARTS]
    return rows.select(F.col("link_id").alias("reg_id"), F.array_compact(F.array(*parts)).alias("parts"))
