"""Log lines, wide files, ways, manifests and layers; zone edges, counts by direction and frames of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.stats import dec
from roadloom.operators.spatial_join import around, in_cells
from roadloom.plans.registry import query
from roadloom.plans.validation import dec_sql
from roadloom.session import dealt, shared_folder
from roadloom.sources import files
from roadloom.sources.fixtures import table, view
from roadloom.sources.zips import read_zips, write_zips

_LINE_SQL = '''strftime(ts, '%Y-%m-%d %H:%M:%S') || ',S,' || user_id || ',' ||
case event_id % 7 when 0 then '' when 1 then 'x' else cast(cast(floor(value) as bigint) as varchar) end ||
case when event_id % 5 > 0 then ',"a, ""b""",' || event_type else '' end'''


@query(f"""with r as (select {_LINE_SQL} as line, event_type from events),
f as (select string_split(line, ',') as f, event_type from r where ends_with(line, event_type) and line like '%"%')
select cast(f[3] as bigint) as det, substr(f[1], 12, 2) as hour, event_type as kind, count(*) as samples,
cast(sum(cast(f[4] as bigint)) as double) as total from f where try_cast(f[4] as bigint) is not null group by 1, 2, 3""")
def a05_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines read by position; short rows and rows of a blank or non-numeric value go."""
    e = F.col("event_id")
    value = F.when(e % 7 == 0, "").when(e % 7 == 1, "x").otherwise(F.floor("value").cast("string"))
    tail = F.when(e % 5 > 0, F.concat(F.lit(',"a, ""b""",'), F.col("event_type"))).otherwise("")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",S,"), F.col("user_id").cast("string"), F.lit(","))
    lines = table(spark, sf_dir, "events").select(F.concat(head, value, tail).alias("value"))
    rows = files.log_rows(lines, {"at": 0, "det": 2, "value": 3, "kind": 5}, least=6, numeric=("det", "value"))
    keys = [F.col("det").cast("long").alias("det"), F.substring("at", 12, 2).alias("hour"), "kind"]
    return rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.sum("value").alias("total"))


@query("""select cast(c_custkey as varchar) as key, c_mktsegment as segment, '札幌 "' || c_name || '"' as name
from customer where c_mktsegment is not null""")
def a04_wide_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of 170 columns written to the shared folder as CSV; three columns read by name."""
    c = F.col("c_custkey").cast("string")
    named = {3: c.alias("key"), 70: F.concat(F.lit('札幌 "'), F.col("c_name"), F.lit('"')).alias("name"), 169: F.col("c_mktsegment").alias("segment")}
    wide = [named.get(k, F.concat(F.lit(f"v{k}-"), c).alias(f"f{k}")) for k in range(170)]
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").select(*wide)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_wide_csv(spark, path, ["key", "segment", "name"], "UTF-8")


@query("""select cast(c_custkey as varchar) as key, '札幌 "' || c_name || '", 北' || c_nationkey as name, length(repeat(c_name, 8000)) as note_chars
from customer where c_custkey % 3 > 0""")
def a04_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as cp932 members of zip archives, with fields of over 128 KB, and read member by member; rows of
    every third customer are of another kind and go."""
    c = F.col("c_custkey")
    text = F.concat(F.lit('札幌 "'), F.col("c_name"), F.lit('", 北'), F.col("c_nationkey").cast("string"))
    # Rows are dealt to all tasks before they get their long field, and each task writes an archive.
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), 2).select(
        F.col("c_name").alias("owner"), F.when(c % 3 > 0, "S").otherwise("T").alias("kind"), c.cast("string").alias("key"), text.alias("name"), F.repeat("c_name", F.lit(8000)).alias("note")
    )
    path = f"{shared_folder(spark)}/zips-{uuid.uuid4().hex}"
    write_zips(rows, path, "control")
    found = read_zips(spark, path, ["kind", "key", "name", "note"], "control*").where("kind = 'S'")
    return found.select("key", "name", F.length("note").cast("long").alias("note_chars"))


@query("""select link_id as id, link_id % 4 in (1, 2) as oneway, case when link_id % 4 = 1 then x2 else x1 end as first_x,
case when link_id % 4 = 1 then y2 else y1 end as first_y from fx_links where category <> 3 and link_id % 6 <> 5""")
def a07_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of an extract: foot ways, ways of one vertex, relations and untagged elements go, reversed ways are turned."""
    k = F.col("link_id")
    end = lambda x, y: F.struct(F.col(x).cast("double").alias("lon"), F.col(y).cast("double").alias("lat"))
    line = F.when(k % 6 == 5, F.array(end("x1", "y1"))).otherwise(F.array(end("x1", "y1"), end("x2", "y2")))
    way = F.when(k % 4 == 1, "-1").when(k % 4 == 2, "yes").otherwise("no")
    kind = F.when(F.col("category") == 3, "footway").otherwise("primary")
    tags = F.create_map(F.lit("highway"), kind, F.lit("oneway"), way)
    other = F.struct(F.lit("relation").alias("type"), k.alias("id"), tags.alias("tags"), line.alias("geometry"))
    bare = F.struct(F.lit("way").alias("type"), (-k).alias("id"), F.lit(None).cast("map<string,string>").alias("tags"), line.alias("geometry"))
    own = F.struct(F.lit("way").alias("type"), k.alias("id"), tags.alias("tags"), line.alias("geometry"))
    ways = files.ways(view(spark, sf_dir, "fx_links").select(F.explode(F.array(own, other, bare)).alias("e")))
    first = F.element_at("line", 1)
    return ways.select("id", "oneway", first["x"].cast("long").alias("first_x"), first["y"].cast("long").alias("first_y"))


@query("""select p_partkey as id, p_partkey % 4 + 3 as n, cast(sum(141 * 1000 + p_partkey % 50 + k) as bigint) as sx, cast(sum(43 * 1000 + k) as bigint) as sy
from part, unnest(range(p_partkey % 4 + 3)) as t(k) where p_partkey % 4 > 0 group by 1, 2""")
def a08_position_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons from texts of latitude, longitude and height; those of fewer than four vertices go."""
    p = F.col("p_partkey")
    degrees = lambda v: F.format_string("%.3f", v / F.lit(1000.0))
    triple = lambda k: F.concat_ws(" ", degrees(F.lit(43_000) + k), degrees(F.lit(141_000) + p % 50 + k), F.lit("0"))
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), p % 4 + 2), triple))
    # The table is small beside the work on its rows, so these are dealt to all tasks; a list that an explode makes is read once.
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey"))
    rows = parts.select(p.alias("id"), F.explode(F.array(files.parse_pos_list(text))).alias("line")).where("line is not null")
    total = lambda axis: F.aggregate("line", F.lit(0).cast("long"), lambda s, q: s + F.round(q[axis] * 1000).cast("long"))
    return rows.select("id", F.size("line").cast("long").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query("""with k as (select p_partkey as k, p_name from part)
select cast(k as varchar) as name, case when k % 11 = 0 then 'missing' when k % 7 = 0 then 'extra' when k % 5 = 0 then 'changed' else 'ok' end as status
from k where not (k % 11 = 0 and k % 7 = 0)""")
def a11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of contents against a manifest; only rows that neither side holds are absent."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, k.cast("string").alias("name"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"))
    found = rows.where(k % 11 != 0).select("name", "sha256")
    expected = rows.where(k % 7 != 0).select("name", F.when(k % 5 == 0, "0").otherwise(F.upper("sha256")).alias("sha256"))
    return files.verify(found, expected)


@query("""select 'nodes' as layer, count(*) as n, cast(sum(nid) as bigint) as ids from fx_nodes
union all select 'links', count(*), cast(sum(link_id) as bigint) from fx_links""")
def a14_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers written to the shared folder, each a table with its own types, and read back."""
    folder = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    ids = {"nodes": ("fx_nodes", "nid"), "links": ("fx_links", "link_id")}
    files.write_layers({name: view(spark, sf_dir, source) for name, (source, _) in ids.items()}, folder)
    parts = [
        spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("layer"), F.count("*").alias("n"), F.sum(key).alias("ids"))
        for name, (_, key) in ids.items()
    ]
    return parts[0].unionByName(parts[1])


#: Links of this class are local; how many of the nearest stand in, and how near they must be.
LOCAL, NEAREST_K, NEAREST_M, ZONE_M = 4, 2, 300, 100
_ZONES_SQL = "z as (select p_partkey as zone, (p_partkey % 50) * case when p_partkey % 11 = 0 then 400 else 100 end as zx, p_partkey // 50 * 100 as zy from part)"


@query(f"""with {_ZONES_SQL},
m as (select link_id, category, x1 + x2 as mx, y1 + y2 as my, sqrt(cast((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) as double)) as len from fx_links),
near as (select zone, link_id, len, category = {LOCAL} as loc, (mx - 2 * zx - 100) * (mx - 2 * zx - 100) + (my - 2 * zy - 100) * (my - 2 * zy - 100) as d2,
  mx > 2 * zx and mx < 2 * zx + 200 and my > 2 * zy and my < 2 * zy + 200 as within
  from z join m on mx between 2 * zx - 500 and 2 * zx + 700 and my between 2 * zy - 500 and 2 * zy + 700),
t as (select *, case when within and loc then 1 when within then 2 when loc then 3 else 4 end as tier from near where within or d2 <= 360000),
k as (select *, min(tier) over (partition by zone) as best, row_number() over (partition by zone, tier order by d2, link_id) as k from t)
select zone, coalesce(tier, 5) as tier, link_id, {dec_sql('len')} as length from z left join (select * from k where tier = best and (tier <= 2 or k <= {NEAREST_K})) k using (zone)""")
def e12_zone_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each zone the first that there is: local links whose middle lies inside (1), any inside (2), the nearest two
    local ones within reach (3), the nearest two of any class (4), none (5). Ties go to the smaller link.

    Lengths are doubled so that middles are whole numbers. A zone is smaller than the reach, so one equi-join on cells
    finds both the inside and the near ones.
    """
    p = F.col("p_partkey")
    zx, zy = (p % 50) * F.when(p % 11 == 0, 400).otherwise(ZONE_M), F.floor(p / 50) * ZONE_M
    zones = table(spark, sf_dir, "part").select(p.alias("zone"), (2 * zx + ZONE_M).alias("px"), (2 * zy + ZONE_M).alias("py"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    mids = view(spark, sf_dir, "fx_links").select(
        "link_id", (F.col("category") == LOCAL).alias("loc"), (F.col("x1") + F.col("x2")).alias("mx"), (F.col("y1") + F.col("y2")).alias("my"),
        F.sqrt((dx * dx + dy * dy).cast("double")).alias("len"),
    )
    reach = 2 * NEAREST_M
    ox, oy = F.col("mx") - F.col("px"), F.col("my") - F.col("py")
    near = around(zones, "px", "py", reach).join(in_cells(mids, "mx", "my", reach), ["cx", "cy"]).withColumn("d2", ox * ox + oy * oy)
    near = near.withColumn("within", (F.abs(ox) < ZONE_M) & (F.abs(oy) < ZONE_M)).where(F.col("within") | (F.col("d2") <= reach * reach))
    tier = F.when(F.col("within"), F.when(F.col("loc"), 1).otherwise(2)).otherwise(F.when(F.col("loc"), 3).otherwise(4))
    best = near.groupBy("zone").agg(F.min(tier).alias("tier"))
    held = near.withColumn("tier", tier).join(best, ["zone", "tier"])
    order = Window.partitionBy("zone").orderBy("d2", "link_id")
    held = held.withColumn("k", F.row_number().over(order)).where((F.col("tier") <= 2) | (F.col("k") <= NEAREST_K))
    out = zones.select("zone").join(held.select("zone", "tier", "link_id", dec(F.col("len")).alias("length")), "zone", "left")
    return out.withColumn("tier", F.coalesce("tier", F.lit(5)))


@query("""with c as (select eid, hour, sum(case when direction = 'up' then cnt end) as up, sum(case when direction = 'down' then cnt end) as down from fx_obs group by 1, 2),
s as (select c_custkey as eid, case when c_custkey % 7 > 0 then c_custkey % 5 - 2 end as vx, c_custkey % 3 - 1 as vy from customer),
w as (select link_id, hour, up, down, case when vx is null then 'avg' when (x2 - x1) * vx + (y2 - y1) * vy >= 0 then 'down' else 'up' end as how
  from fx_links join s on s.eid = a join c using (eid))
select link_id, hour, how, cast(case how when 'down' then down when 'up' then up
  else (coalesce(up, 0) + coalesce(down, 0)) / case when up is null or down is null then 1.0 else 2.0 end end as double) as cnt from w""")
def e21_direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a link's section in its own direction: down where the link's vector and the section's down-vector agree,
    else up; without such a vector the mean of what there is."""
    way = lambda d: F.sum(F.when(F.col("direction") == d, F.col("cnt")))
    counts = view(spark, sf_dir, "fx_obs").groupBy("eid", "hour").agg(way("up").alias("up"), way("down").alias("down"))
    c = F.col("c_custkey")
    sections = table(spark, sf_dir, "customer").select(c.alias("eid"), F.when(c % 7 > 0, c % 5 - 2).alias("vx"), (c % 3 - 1).alias("vy"))
    links = view(spark, sf_dir, "fx_links").withColumnRenamed("a", "eid").join(sections, "eid").join(counts, "eid")
    dot = (F.col("x2") - F.col("x1")) * F.col("vx") + (F.col("y2") - F.col("y1")) * F.col("vy")
    how = F.when(dot.isNull(), "avg").when(dot >= 0, "down").otherwise("up")
    both = F.when(F.col("up").isNull() | F.col("down").isNull(), 1.0).otherwise(2.0)
    mean = (F.coalesce("up", F.lit(0)) + F.coalesce("down", F.lit(0))) / both
    cnt = F.when(how == "down", F.col("down").cast("double")).when(how == "up", F.col("up").cast("double")).otherwise(mean)
    return links.select("link_id", "hour", how.alias("how"), cnt.alias("cnt"))


@query(f"""with r as (select event_type as run, cast(date_trunc('minute', ts) as timestamp) as frame, cast(floor(value * 10) as bigint) as v_dm,
  (event_id % 1000) * 13 as x_dm from events where value >= 0 and event_id % 29 > 0),
f as (select run, frame, count(*) as n, sum(v_dm) as v, sum(x_dm) as x from r group by 1, 2),
s as (select run, min(n) as lo, max(n) as hi, sum(n) as total, count(*) as frames from f group by 1)
select run, frame, n, cast(x as bigint) as x_dm, {dec_sql('cast(v as double) / n / 10')} as mean_speed, lo, hi, {dec_sql('cast(total as double) / frames')} as mean_n from f join s using (run)""")
def f27_run_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a run with decimetre sums, and the least, greatest and mean count of the run's frames. Pings without a
    position or with a negative speed are left out."""
    e, v = F.col("event_id"), F.col("value")
    pings = table(spark, sf_dir, "events").where((v >= 0) & (e % 29 > 0)).select(
        F.col("event_type").alias("run"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("frame"), F.floor(v * 10).alias("v"), ((e % 1000) * 13).alias("x")
    )
    frames = pings.groupBy("run", "frame").agg(F.count("*").alias("n"), F.sum("x").alias("x_dm"), F.sum("v").alias("v"))
    runs = frames.groupBy("run").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("total"), F.count("*").alias("frames"))
    mean = dec(F.col("v").cast("double") / F.col("n") / 10).alias("mean_speed")
    return frames.join(runs, "run").select("run", "frame", "n", "x_dm", mean, "lo", "hi", dec(F.col("total").cast("double") / F.col("frames")).alias("mean_n"))
