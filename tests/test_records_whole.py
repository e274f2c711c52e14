"""Archives member by member, batches that come again, areas made one."""

from __future__ import annotations

import csv
import io
import random
import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo as G
from roadloom.operators.faces import dissolve, rings_of
from roadloom.plans import registry
from roadloom.sources.zips import quoted, read_zips, write_zips
from roadloom.streaming.jobs import latest, write_batch, write_stream

RING = "array<struct<x:double,y:double>>"


def test_members_of_archives(spark, tmp_path):
    long = "長" * 150_000
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("制御1.csv", f'種別,番号,備考\r\nS,1,"a ""b"", c\nd"\r\nS,2\r\nS,3,{long},more\r\n'.encode("cp932"))
        z.writestr("検知.csv", "種別,番号,備考\r\nX,9,no\r\n".encode("cp932"))
        z.writestr("制御0.csv", b"")
    with zipfile.ZipFile(tmp_path / "b.ZIP", "w") as z:
        z.writestr("dir/制御2.csv", "備考,種別,番号\r\n".encode("cp932") + b"\x82,S,4\r\n")
    (tmp_path / "c.txt").write_text("no archive")
    df = read_zips(spark, str(tmp_path), ["番号", "備考"], "*制御*")
    assert df.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in df.collect()) == sorted([("制御1.csv", "1", 'a "b", c\nd'), ("制御1.csv", "3", long), ("dir/制御2.csv", "4", "�")])
    assert {r[0] for r in read_zips(spark, f"file:{tmp_path}/a.zip", ["種別"]).select("種別").collect()} == {"S", "X"}
    with pytest.raises(Exception, match="nowhere"):
        read_zips(spark, str(tmp_path), ["nowhere"], "*制御*").collect()


def test_archives_written_and_read(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit('札幌, "'), F.col("id"), F.lit('"\n')).alias("name")).repartition(3)
    write_zips(rows, str(tmp_path), "m")
    assert len(list(tmp_path.glob("*.zip"))) == 3 and not list(tmp_path.glob("_*"))
    assert sorted(map(tuple, read_zips(spark, str(tmp_path), ["key", "name"]).drop("member").collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "none").mkdir()
    assert read_zips(spark, f"{tmp_path}/none", ["key"]).count() == 0


def test_zip_members_hold_every_customer(spark):
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey", "c_name").collect()
    want = {(str(c.c_custkey), 8000 * len(c.c_name)) for c in customers if c.c_custkey % 3 > 0}
    found = registry.queries()["a04_zip_members"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(want) == 100 and {(r["key"], r["note_chars"]) for r in found} == want


def test_rows_are_quoted_as_the_csv_module_does():
    rows = [("a", 'b "c"', '"', "", None, "d\ne\r\n,"), (1, -2.5, True, "北", "x" * 9, '""'), (None,)]
    out = io.StringIO(newline="")
    csv.writer(out, quoting=csv.QUOTE_ALL).writerows(rows)
    assert "".join(map(quoted, rows)) == out.getvalue()


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    base = spark.range(40).select(F.col("id"), (F.col("id") % 4).alias("det"))
    source, folder, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    read = lambda: spark.readStream.schema(base.schema).parquet(source).groupBy("det").agg(F.count("*").alias("n"))
    for low in (0, 20):
        base.where(f"id between {low} and {low + 19}").coalesce(1).write.mode("append").parquet(source)
        write_stream(read(), folder, state, "update").awaitTermination(60)
    assert {r.det: r.n for r in latest(spark, folder, ["det"]).collect()} == dict.fromkeys(range(4), 10)
    before = sorted(map(tuple, spark.read.parquet(folder).collect()))
    # The job stopped after it wrote its last batch and before it noted that: the batch is replayed.
    for p in Path(state, "commits").glob("*1*"):
        p.unlink()
    base.where("id < 4").coalesce(1).write.mode("append").parquet(source)
    write_stream(read(), folder, state, "update").awaitTermination(60)
    after = sorted(map(tuple, spark.read.parquet(folder).where("batch < 2").collect()))
    assert after == before and {r.det: r.n for r in latest(spark, folder, ["det"]).collect()} == dict.fromkeys(range(4), 11)
    write_batch(base.where("id < 2"), 7, f"{tmp_path}/plain")
    write_batch(base.where("id < 2"), 7, f"{tmp_path}/plain")
    assert spark.read.parquet(f"{tmp_path}/plain").count() == 2
    shutil.rmtree(folder)


def square(x, y, side=1.0):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def test_areas_become_one(spark):
    around = [square(float(i), float(j)) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    rows = [("hole", r) for r in around] + [("turned", square(0.0, 0.0)), ("turned", square(1.0, 0.0)[::-1]), ("open", square(5.0, 5.0)[:-1]), ("corner", square(0.0, 0.0)), ("corner", square(1.0, 1.0)), (None, square(9.0, 9.0)), ("line", [(0.0, 0.0), (1.0, 1.0)])]
    got = {r.k: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in dissolve(spark.createDataFrame(rows, f"k string, ring {RING}").repartition(3), ["k"]).collect()}
    assert {k: sorted(map(area, v)) for k, v in got.items()} == {"hole": [-1.0, 9.0], "turned": [2.0], "open": [1.0], "corner": [1.0, 1.0], None: [1.0]}
    assert [len(r) for r in got["turned"]] == [5] and [len(r) for r in got["hole"]] == [5, 5]  # straight borders keep no vertex
    assert dissolve(spark.createDataFrame([], f"k string, ring {RING}"), ["k"]).count() == 0


def test_random_lots_keep_their_area(spark):
    rng = random.Random(4)
    lots = [(rng.randint(0, 2), square(float(i), float(j))) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(lots, f"k int, ring {RING}")
    for r in dissolve(df, ["k"]).withColumn("border", F.aggregate(F.transform("rings", G.line_length), F.lit(0.0), lambda a, v: a + v)).collect():
        own = {ring[0] for k, ring in lots if k == r.k}
        sides = sum((x + dx, y + dy) not in own for x, y in own for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert sum(area([(p.x, p.y) for p in ring]) for ring in r.rings) == len(own) and r.border == sides


def test_rings_that_meet_in_a_point_stay_apart():
    edges = [e for s in (square(0.0, 0.0), square(1.0, 1.0)) for e in zip(s, s[1:], strict=False)]
    assert sorted(area(r) for r in rings_of(edges)) == [1.0, 1.0]
