"""Readers, sinks and small functions on files and rows that the tests write."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from roadloom.functions import geo as G
from roadloom.functions.text import town_key
from roadloom.operators.reach import cap_hops
from roadloom.sources import files
from roadloom.sources.intervals import hourly_flows, read_intervals


def test_interval_files_give_hourly_flows(spark, tmp_path):
    edges = '<edge id="5" flow="10.5" speed="8"/><edge id="5.-60" flow="3"/>'
    (tmp_path / "a.xml").write_text(f'<meandata><interval begin="0.0" end="3600.0">{edges}</interval><interval begin="3600.0" end="4000.0">{edges}</interval></meandata>')
    assert [tuple(r) for r in hourly_flows(read_intervals(spark, str(tmp_path / "a.xml")), 7).collect()] == [(7, 5, 10.5)]


def test_ways_are_kept_and_turned(spark, tmp_path):
    two = [{"lon": 1.0, "lat": 2.0}, {"lon": 3.0, "lat": 4.0}]
    way = lambda i, tags, g=two: {"type": "way", "id": i, "tags": tags, "geometry": g}
    rows = [way(1, {"oneway": "-1", "highway": "primary"}), way(2, {"highway": "footway"}), way(3, {"highway": "primary"}, two[:1]), way(4, {"name": "n"}), {"type": "relation", "id": 5, "tags": {"a": "b"}}]
    (tmp_path / "w.json").write_text(json.dumps({"elements": rows}))
    got = {r["id"]: ([tuple(p) for p in r["line"]], r["oneway"]) for r in files.read_ways(spark, str(tmp_path / "w.json")).collect()}
    assert got == {1: ([(3.0, 4.0), (1.0, 2.0)], True), 4: ([(1.0, 2.0), (3.0, 4.0)], False)}


def test_pos_lists_swap_axes(spark):
    df = spark.createDataFrame([("43 141 0 43 142 0 44 142 0 43 141 0",), ("43 141 0",), (None,)], "t string")
    got = [r[0] and [tuple(p) for p in r[0]] for r in df.select(files.parse_pos_list(F.col("t"))).collect()]
    assert got == [[(141.0, 43.0), (142.0, 43.0), (142.0, 44.0), (141.0, 43.0)], None, None]


def test_wide_csv_selects_by_name_and_drops_short_rows(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,b,c\n1,"x, ""y""",3\n2\n4,z,5\n', encoding="utf-8")
    got = {tuple(r) for r in files.read_wide_csv(spark, str(tmp_path / "c.csv"), ["b", "a"], "UTF-8").collect()}
    assert got == {('x, "y"', "1"), ("z", "4")}


def test_log_rows_by_position(spark):
    lines = ["at,code,n,v", 'x,"a, ""b""",1,2.5', "x,y,1", "x,y,,3", "x,y,1,", "x,y,q,3", "x,y,NaN,3", "x,y, 7 ,Infinity", "x,y, 7 ,3,more", "", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [tuple(r) for r in files.log_rows(df, {"code": 1, "n": 2, "v": 3}, 4, ("n", "v")).collect()]
    assert got == [('a, "b"', 1.0, 2.5), ("y", 7.0, 3.0)]
    assert files.log_rows(df.limit(0), {"n": 0}, 1, ("n",)).count() == 0


def test_checksums_and_layers(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name in ("one", "two", "three"):
        (tmp_path / "f" / name).write_bytes(name.encode())
    want = [("one", hashlib.sha256(b"one").hexdigest().upper()), ("two", "0"), ("four", "1")]
    status = files.verify(files.checksums(spark, str(tmp_path / "f")), spark.createDataFrame(want, "name string, sha256 string"))
    assert {tuple(r) for r in status.collect()} == {("one", "ok"), ("two", "changed"), ("three", "extra"), ("four", "missing")}
    files.write_layers({"x": spark.range(3), "y": spark.range(0)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "x")).count() == 3 and spark.read.parquet(str(tmp_path / "out" / "y")).count() == 0


def test_hop_cap_cuts_and_leads_out(spark):
    long = [str(i) for i in range(40)]
    routes = spark.createDataFrame([(1, long), (2, long[:30]), (3, []), (4, long[5:])], "veh long, route array<string>")
    paths = spark.createDataFrame([("30", ["a", "b"])], "sid string, path array<string>")
    got = {r["veh"]: (r["cut"], r["route"]) for r in cap_hops(routes, paths, 30).collect()}
    assert got == {1: (True, long[:31] + ["a", "b"]), 2: (False, long[:30]), 3: (False, []), 4: (True, long[5:36])}


def test_town_keys_and_projection(spark):
    df = spark.createDataFrame([("旭ケ丘一丁目",), ("八軒一条西１丁目",), ("円山西町（番地）",), ("二三線",), ("ﾊﾁｹﾝ①丁目",), (None,)], "t string")
    assert [r[0] for r in df.select(town_key(F.col("t"))).collect()] == ["旭ケ丘1丁目", "八軒1条西1丁目", "円山西町", "3線", "ハチケン1丁目", None]
    at = spark.createDataFrame([(142.25, 44.0), (141.35, 43.06)], "lon double, lat double")
    x, y = G.project(F.col("lon"), F.col("lat"), 142.25, 44.0)
    near, far = at.select("lon", "lat", x.alias("x"), y.alias("y")).collect()
    assert abs(near["x"]) < 1e-6 and abs(near["y"]) < 1e-6 and abs(far["x"]) > 70_000
    lon, lat = G.unproject(F.lit(far["x"]), F.lit(far["y"]), 142.25, 44.0)
    back = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(back["lon"] - 141.35) < 1e-9 and abs(back["lat"] - 43.06) < 1e-9
