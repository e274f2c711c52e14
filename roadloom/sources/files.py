"""Readers of files with their own shape, checksums, and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.geo import point

_TAGS = "map<string,string>"
_ELEMENTS = f"elements array<struct<type: string, id: bigint, tags: {_TAGS}, geometry: array<struct<lon: double, lat: double>>>>"
#: Ways that carry no vehicles.
FOOT_WAYS = ("footway", "path", "cycleway", "steps", "pedestrian")


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """(id, tags, line, oneway) of ways in JSON extracts; foot ways and ways of fewer than two vertices go, and a way
    that is one-way against its vertices is turned. Relations and elements without tags are left out."""
    return ways(spark.read.schema(_ELEMENTS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")))


def ways(elements: DataFrame) -> DataFrame:
    """The rows of ``read_ways`` of elements in a column ``e``."""
    rows = elements.select("e.*")
    kept = rows.where((F.col("type") == "way") & F.col("tags").isNotNull() & (F.size("geometry") >= 2) & ~F.coalesce(F.col("tags")["highway"].isin(*FOOT_WAYS), F.lit(False)))
    line = F.transform("geometry", lambda p: point(p["lon"], p["lat"]))
    oneway = F.col("tags")["oneway"]
    return kept.select("id", "tags", F.when(oneway == "-1", F.reverse(line)).otherwise(line).alias("line"), F.coalesce(oneway.isin("-1", "yes", "1"), F.lit(False)).alias("oneway"))


def parse_pos_list(text, least: int = 4):
    """array<struct<x, y>> of ``lat lon height`` triples with x the longitude; null for fewer than ``least`` points."""
    one = lambda of, then: F.element_at(F.transform(F.array(of), then), 1)  # noqa: E731 - names a value, so that it is made once

    def points(values: Column) -> Column:
        n = F.floor(F.size(values) / 3).cast("int")
        return F.when(n >= least, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: point(F.get(values, i * 3 + 1), F.get(values, i * 3))))

    return one(F.transform(F.split(F.trim(text), "\\s+"), lambda v: v.try_cast("double")), points)


def read_wide_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "windows-31j") -> DataFrame:
    """The named columns, as text, of CSV files with a header, of any width and length of field. Rows too short to have
    all columns named go. The session needs spark.sql.legacy.javaCharsets for encodings that Spark does not list."""
    rows = spark.read.option("header", True).option("encoding", encoding).option("maxCharsPerColumn", -1).option("maxColumns", 4096).option("quote", '"').option("escape", '"').csv(path)
    return rows.select(*[F.col(f"`{c}`") for c in columns]).where(" and ".join(f"`{c}` is not null" for c in columns))


def csv_fields(line: Column) -> Column:
    """The fields of one CSV line; commas inside quotes part nothing, quotes go and doubled ones count once."""
    fields = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(fields, lambda f: F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"')))


def log_rows(lines: DataFrame, positions: dict[str, int], least: int, numeric: tuple[str, ...]) -> DataFrame:
    """Columns of log lines (value) by position, those of ``numeric`` as doubles. Lines of fewer than ``least`` fields go,
    and so do lines whose numeric fields are blank or no finite number (a header among them); null lines too."""
    rows = lines.select(csv_fields(F.col("value")).alias("f")).where(F.size("f") >= least)
    text = {name: F.get("f", F.lit(at)) for name, at in positions.items()}
    typed = rows.select(*[(F.trim(c).try_cast("double") if name in numeric else c).alias(name) for name, c in text.items()])
    for name in numeric:
        typed = typed.where(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf")))
    return typed


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files at a path."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, status) of expected sums (name, sha256): ok, changed or missing; files not expected are ``extra``."""
    both = expected.select("name", F.col("sha256").alias("want")).join(found.select("name", F.col("sha256").alias("got")), "name", "full_outer")
    status = F.when(F.col("want").isNull(), "extra").when(F.col("got").isNull(), "missing").when(F.lower("want") == F.col("got"), "ok").otherwise("changed")
    return both.select("name", status.alias("status"))


def write_layers(layers: dict[str, DataFrame], folder: str) -> None:
    """Each layer as a Parquet table of its own; one that is there is replaced."""
    for name, rows in layers.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
