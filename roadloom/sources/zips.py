"""Delimited files inside zip archives, in any encoding that Python knows, as a Spark data source.

A member of an archive is a partition of its own and is decoded and parsed while it is inflated, so neither archives nor
members are ever held whole, fields may have any length, and no setting of the session plays a part.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import sys
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of an Arrow batch, and its characters, beyond which it ends.
ROWS, CHARS = 2000, 4_000_000


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Member(InputPartition):
    def __init__(self, uri: str, name: str):
        self.uri, self.name = uri, name


class ZipReader(DataSourceReader):
    """Reads the named columns of every member whose name fits ``member``; see ``read_zips``."""

    def __init__(self, options: dict):
        self.options = options
        self.columns = options["columns"].split(",")

    def archives(self) -> list[str]:
        fs, path = place(self.options["path"])
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".zip"))

    def partitions(self) -> list[Member]:
        fs, _ = place(self.options["path"])
        out = []
        for path in self.archives():
            with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
                out += [Member(path, n) for n in archive.namelist() if fnmatch.fnmatch(n, self.options.get("member", "*")) and not n.endswith("/")]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive there
            return
        csv.field_size_limit(sys.maxsize)
        schema = pa.schema([(c, pa.string()) for c in ["member", *self.columns]])
        fs, _ = place(self.options["path"])
        with fs.open_input_file(partition.uri) as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.name) as member:
            lines = csv.reader(io.TextIOWrapper(member, encoding=self.options.get("encoding", "cp932"), errors="replace", newline=""))
            head = next(lines, None)
            if head is None:
                return
            at = [head.index(c) for c in self.columns]
            rows: list[tuple] = []
            held = 0
            for line in lines:
                if len(line) > max(at):
                    rows.append((partition.name, *(line[i] for i in at)))
                    held += sum(map(len, rows[-1]))
                if len(rows) == ROWS or held >= CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in ["member", *self.options["columns"].split(",")])

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def read_zips(spark: SparkSession, path: str, columns: list[str], member: str = "*", encoding: str = "cp932") -> DataFrame:
    """(member, columns...) as text, of the zip archives at ``path``, a folder or one archive.

    Members have a header; those whose name does not fit the pattern ``member`` are left out, and so are rows too short to
    have all columns named. Bytes that the encoding does not know become U+FFFD. A column that a header lacks is an error.
    """
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_csv").option("columns", ",".join(columns)).option("member", member).option("encoding", encoding).load(path)


def quoted(row: Iterable) -> str:
    """The line that ``csv.writer`` makes of a row with all fields quoted; it goes through long fields three times slower."""
    return ",".join('""' if v is None else '"' + str(v).replace('"', '""') + '"' for v in row) + "\r\n"


def write_zips(rows: DataFrame, folder: str, name: str, encoding: str = "cp932") -> None:
    """An archive for each partition of ``rows`` in ``folder``, with a quoted member ``name``.csv and a header; moved there
    once whole. Values that the encoding lacks become question marks."""
    fs, base = place(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = f"{base}/_{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(mark, compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(f"{name}.csv", "w", force_zip64=True) as member:
            text = io.TextIOWrapper(member, encoding=encoding, errors="replace", newline="")
            text.write(quoted(columns))
            for batch in batches:
                text.writelines(map(quoted, zip(*(c.to_pylist() for c in batch.columns), strict=True)))
                n += batch.num_rows
            text.flush()
            text.detach()
        fs.move(mark, f"{mark.replace('/_', '/')}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    columns = rows.columns
    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
