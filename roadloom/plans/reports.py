"""Histograms, distributions, completeness and match rates; scans, sources and sinks as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import text as T
from roadloom.functions.stats import dec
from roadloom.operators.quantiles import exact_quantiles
from roadloom.plans.registry import query
from roadloom.plans.validation import dec_sql
from roadloom.sources.fixtures import table, view


@query("""select 'category' as name, cast(category as varchar) as value, count(*) as n from fx_links group by 2 union all select 'state', state, count(*) from fx_links group by 2
union all select 'oneway', oneway, count(*) from fx_links group by 2 union all select 'width', cast(width_cls as varchar), count(*) from fx_links group by 2""")
def f13_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four histograms in one scan: each row becomes four (name, value) pairs that combine before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in (("category", "category"), ("state", "state"), ("oneway", "oneway"), ("width", "width_cls"))])
    return view(spark, sf_dir, "fx_links").select(F.explode(pairs).alias("p")).select("p.*").groupBy("name", "value").agg(F.count("*").alias("n"))


@query(f"""select category, count(*) as n, min(len) as low, {dec_sql('quantile_cont(len, 0.05)')} as p05, {dec_sql('quantile_cont(len, 0.5)')} as p50, {dec_sql('quantile_cont(len, 0.95)')} as p95, max(len) as high, count(*) filter (len < 12) as under_12
from (select category, abs(x2 - x1) + abs(y2 - y1) + link_id % 23 as len from fx_links) group by 1""")
def f14_length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "fx_links").select("category", (F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")) + F.col("link_id") % 23).alias("len"))
    found = exact_quantiles(own, ["category"], "len", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    short = own.groupBy("category").agg(F.count(F.when(F.col("len") < 12, 1)).alias("under_12"))
    whole = [F.col(c).cast("long").alias(c) for c in ("low", "high")]
    return found.join(short, "category").select("category", "n", whole[0], *[dec(F.col(c)).alias(c) for c in ("p05", "p50", "p95")], whole[1], "under_12")


@query("""select 'state' as name, count(*) filter (trim(state) <> '') as filled, count(*) as n from fx_links union all select 'oneway', count(*) filter (trim(oneway) <> ''), count(*) from fx_links union all select 'category', count(category), count(*) from fx_links""")
def f15_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("state", "oneway", "category")])
    rows = view(spark, sf_dir, "fx_links").select(F.explode(cells).alias("p")).select("p.*")
    return rows.groupBy("name").agg(F.count(F.when(F.trim("value") != "", 1)).alias("filled"), F.count("*").alias("n"))


@query(f"""with u as (select 'o_custkey' as name, cast(o_custkey as double) as v from orders union all select 'o_orderkey', cast(o_orderkey as double) from orders)
select name, count(v) as n, min(v) as low, {dec_sql('median(v)')} as mid, max(v) as high from u group by 1""")
def f16_numeric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("double"), F.col("o_orderkey").cast("double")).unpivot([], ["o_custkey", "o_orderkey"], "name", "v")
    return exact_quantiles(rows, ["name"], "v", {"mid": 0.5}).select("name", "n", "low", dec(F.col("mid")).alias("mid"), "high")


@query(f"""select (select sum(abs(x2 - x1) + abs(y2 - y1)) from fx_links where x1 < 3000) as clipped, (select sum(abs(x2 - x1) + abs(y2 - y1)) from fx_links) as total,
  {dec_sql('(select sum(abs(x2 - x1) + abs(y2 - y1)) from fx_links where x1 < 3000) / cast((select sum(abs(x2 - x1) + abs(y2 - y1)) from fx_links) as double)')} as coverage""")
def f17_coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    own = view(spark, sf_dir, "fx_links").agg(F.sum(F.when(F.col("x1") < 3000, size)).alias("clipped"), F.sum(size).alias("total"))
    return own.withColumn("coverage", dec(F.col("clipped") / F.col("total").cast("double")))


@query(f"""select coalesce(lang, '(all)') as lang, count(*) as n, sum(n_chars) as total, sum(case when source = 'src0' then n_chars else 0 end) as tagged,
  {dec_sql("sum(case when source = 'src0' then n_chars else 0 end) / cast(sum(n_chars) as double)")} as share from documents group by rollup(lang)""")
def f20_length_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.sum(F.when(F.col("source") == "src0", F.col("n_chars")).otherwise(0))
    own = table(spark, sf_dir, "documents").rollup("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), tagged.alias("tagged"))
    return own.select(F.coalesce("lang", F.lit("(all)")).alias("lang"), "n", "total", "tagged", dec(F.col("tagged") / F.col("total").cast("double")).alias("share"))


@query("""with d as (select unnest(['11', '63', '98', '99']) as code) select d.code, count(s.sign_id) as n, count(s.sign_id) filter (s.x < 3000) as clipped from d left join fx_signs s on s.code = d.code group by 1""")
def f21_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per code of a fixed list, zero rows kept; the counts are made first, so the list joins totals."""
    counts = view(spark, sf_dir, "fx_signs").groupBy("code").agg(F.count("*").alias("n"), F.count(F.when(F.col("x") < 3000, 1)).alias("clipped"))
    codes = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in ("11", "63", "98", "99")])).alias("code"))
    return codes.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("clipped", F.lit(0)).alias("clipped"))


@query("select count(*) filter (oneway = '') as no_oneway, count(*) filter (state = '1') as default_state, count(*) as n from fx_links")
def f26_assumed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_links").agg(F.count(F.when(F.col("oneway") == "", 1)).alias("no_oneway"), F.count(F.when(F.col("state") == "1", 1)).alias("default_state"), F.count("*").alias("n"))


@query("""select category, sum(case when state in ('2', '3') then 0 else 1 end) as vehicular, sum(case when state in ('2', '3') then 1 else 0 end) as other, sum(abs(x2 - x1) + abs(y2 - y1)) as length_m from fx_links group by 1""")
def f29_clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.col("state").isin("2", "3")
    return view(spark, sf_dir, "fx_links").groupBy("category").agg(F.sum(F.when(other, 0).otherwise(1)).alias("vehicular"), F.sum(F.when(other, 1).otherwise(0)).alias("other"), F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("length_m"))


@query(f"""with c as (select l_suppkey as id, l_orderkey % 24 as hour, avg(60 + l_partkey % 90) as cycle from lineitem group by 1, 2), k as (select *, row_number() over (partition by id order by cycle, hour) as k, count(*) over (partition by id) as n from c)
select s_suppkey as id, {dec_sql('coalesce(cycle, 120)')} as cycle_s, 3 as yellow_s, 2 as all_red_s from supplier left join k on id = s_suppkey and k = n // 2 + 1""")
def f25_plan_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of at most 24 hourly cycles, with defaults where there is no plan."""
    hourly = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") % 24).alias("hour")).agg(F.avg(60 + F.col("l_partkey") % 90).alias("cycle"))
    mid = hourly.groupBy("id").agg(F.sort_array(F.collect_list("cycle")).alias("c")).select("id", F.element_at("c", (F.floor(F.size("c") / 2) + 1).cast("int")).alias("cycle"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(mid, "id", "left").select("id", dec(F.coalesce("cycle", F.lit(120.0))).alias("cycle_s"), F.lit(3).alias("yellow_s"), F.lit(2).alias("all_red_s"))


@query(f"""select det, cast(date_trunc('minute', ts) as timestamp) as minute, count(*) as n, {dec_sql('avg(volume)')} as mean_volume from fx_sensor where volume >= 0 group by 1, 2""")
def f27_frame_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_sensor").where("volume >= 0")
    return rows.groupBy("det", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"), dec(F.avg("volume")).alias("mean_volume"))


@query("select eid, sum(flow) as waiting from fx_flow group by 1 order by waiting desc, eid limit 10")
def f28_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_flow").groupBy("eid").agg(F.sum("flow").alias("waiting")).orderBy(F.desc("waiting"), "eid").limit(10)


@query("""select case when category in (1, 2) then 'main' else 'local' end as kind, category, link_id from fx_links where state not in ('2', '3')""")
def b01_vehicular_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_links").where(~F.col("state").isin("2", "3")).select(F.when(F.col("category").isin(1, 2), "main").otherwise("local").alias("kind"), "category", "link_id")


@query("select link_id, case state when '1' then 'ordinary' when '2' then 'bridge' when '3' then 'tunnel' else 'other' end as label from fx_links")
def b02_code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for kv in {"1": "ordinary", "2": "bridge", "3": "tunnel"}.items() for x in kv])
    return view(spark, sf_dir, "fx_links").select("link_id", F.coalesce(labels[F.col("state")], F.lit("other")).alias("label"))


@query("""with r as (select case when x1 between 1000 and 3000 and y1 between 0 and 2000 then 'core' when category in (1, 2) then 'category' when category = 4 and width_cls >= 4 then 'wide' else 'none' end as reason from fx_links) select reason, count(*) as n from r group by 1""")
def b03_road_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive reasons for which a road is selected, the first that holds."""
    core = F.col("x1").between(1000, 3000) & F.col("y1").between(0, 2000)
    reason = F.when(core, "core").when(F.col("category").isin(1, 2), "category").when((F.col("category") == 4) & (F.col("width_cls") >= 4), "wide").otherwise("none")
    return view(spark, sf_dir, "fx_links").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("select link_id, case when n = 1 then 'point' when code = 3 and n >= 3 then 'area' else 'line' end as kind from (select link_id, link_id % 5 + 1 as n, link_id % 4 as code from fx_links)")
def b06_geometry_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, code = F.col("link_id") % 5 + 1, F.col("link_id") % 4
    return view(spark, sf_dir, "fx_links").select("link_id", F.when(n == 1, "point").when((code == 3) & (n >= 3), "area").otherwise("line").alias("kind"))


@query("select s_suppkey as uid, trim(coalesce(s_name, '')) as name, trim(coalesce(case when s_suppkey % 3 = 0 then null else '  n ' end, '')) as note from supplier")
def b07_alias_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).otherwise("  n ")
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), clean(F.col("s_name")).alias("name"), clean(note).alias("note"))


_POINTS_SQL = "case o_orderkey % 4 when 0 then '141.' || (o_orderkey % 90 + 10) || ' 43.05;141.5 43.' || (o_custkey % 90 + 10) when 1 then '141.0;x y;140.25 42.5' when 2 then '10.0 43.0;141.25 43.5' else '' end"


@query(f"""with r as (select o_orderkey, unnest(string_split({_POINTS_SQL}, ';')) as t from orders), p as (select o_orderkey, try_cast(split_part(t, ' ', 1) as double) as x, try_cast(split_part(t, ' ', 2) as double) as y, len(string_split(t, ' ')) as n from r)
select o_orderkey, count(*) as n, sum(cast(x * 100 as bigint)) as sx, sum(cast(y * 100 as bigint)) as sy from p where n = 2 and x between 122 and 154 and y between 20 and 46 group by 1""")
def a21_parse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("o_orderkey") % 4, F.col("o_orderkey")
    text = F.when(k == 0, F.concat(F.lit("141."), (o % 90 + 10).cast("string"), F.lit(" 43.05;141.5 43."), (F.col("o_custkey") % 90 + 10).cast("string"))).when(k == 1, "141.0;x y;140.25 42.5").when(k == 2, "10.0 43.0;141.25 43.5").otherwise("")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.parse_points(text)).alias("p"))
    whole = lambda c: F.sum(F.round(c * 100).cast("long"))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("n"), whole(F.col("p.x")).alias("sx"), whole(F.col("p.y")).alias("sy"))


@query("select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)<', 1)) as label from pages")
def a10_pattern_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in HTML by pattern, a row for each match."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1).alias("href"), F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)<'), 1).alias("label"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(both).alias("z")).select("page_id", "z.href", "z.label")


@query("select p_partkey as key_code, p_size as population from part where p_brand in ('Brand#11', 'Brand#22', 'Brand#33')")
def a03_pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33")).select(F.col("p_partkey").alias("key_code"), F.col("p_size").alias("population"))


@query("select c_custkey as section_id, c_nationkey as muni, c_acctbal as v24h from customer")
def a02_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("section_id"), F.col("c_nationkey").alias("muni"), F.col("c_acctbal").alias("v24h"))


@query("select 'supplier' as part, s_suppkey as id from supplier union all select 'customer', c_custkey from customer")
def a01_partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files as one table, each row tagged with its file's name."""
    name = F.regexp_extract(F.input_file_name(), "/(\\w+)\\.parquet", 1)
    own = table(spark, sf_dir, "supplier").select(name.alias("part"), F.col("s_suppkey").alias("id"))
    return own.unionByName(table(spark, sf_dir, "customer").select(name.alias("part"), F.col("c_custkey").alias("id")))


@query("select eid, hour, cast(round_even(flow / 1000.0, 0) as bigint) as n from fx_flow where cast(round_even(flow / 1000.0, 0) as bigint) > 0")
def a19_flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.bround(F.col("flow") / F.lit(1000.0), 0).cast("long")
    return view(spark, sf_dir, "fx_flow").select("eid", "hour", n.alias("n")).where("n > 0")


@query("""select stage, metric, cast(value as double) as value from (select 'links' as stage, 'rows' as metric, count(*) as value from fx_links union all select 'links', 'oneway', count(*) from fx_links where oneway <> '' union all select 'nodes', 'rows', count(*) from fx_nodes)""")
def a16_stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "fx_links").agg(F.count("*").alias("rows"), F.count(F.when(F.col("oneway") != "", 1)).alias("oneway")).unpivot([], ["rows", "oneway"], "metric", "value").withColumn("stage", F.lit("links"))
    nodes = view(spark, sf_dir, "fx_nodes").agg(F.count("*").alias("rows")).unpivot([], ["rows"], "metric", "value").withColumn("stage", F.lit("nodes"))
    return links.unionByName(nodes).select("stage", "metric", F.col("value").cast("double").alias("value"))
