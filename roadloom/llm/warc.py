"""WARC archives of pages: written as whole-file gzip streams, normalised to a gzip member for each record, read by offset.

Spark's text sink writes the records of a partition as one gzip stream, which can only be read from its start. The
normaliser inflates such a stream once, in pieces, writes every record as a member of its own and puts a sidecar index
of offsets beside the archive. Readers then take single records by offset and length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import bound_batches
from roadloom.operators.graph import split_join
from roadloom.session import checkpointed

#: Bytes that are read, inflated or deflated at once; bytes that the head of a record may have.
PIECE, MOST_HEAD = 1 << 20, 1 << 20
END = b"\r\n\r\n"
#: Fixed value: the profile of a record that repeats an earlier payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, type string, record_id string, page_id long, uri string"
RECORDS = "archive string, offset long, page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string's UTF-8 bytes in base 32, upper case: five hexadecimal digits are four of base 32."""
    digest = F.sha1(F.encode(payload, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_bytes, payload_digest and refers_to, the smallest page_id of
    those with an equal payload of at least ``min_bytes``, or null where the row is that one.

    Only digests are grouped, and where few payloads occur again the join back is small enough for Spark to send it to the
    pages; else rows with a payload that many share are split. Null page_ids come last; where all of a group are null,
    none refers to another. Rows that repeat the smallest page_id are responses too.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    keys = rows.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    again = keys.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null").drop("n")
    both = split_join(rows, checkpointed(again), ["payload_digest", "payload_bytes"], "left")
    return both.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def warc_records(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record) WARC records without their last line end, one for each page: a response with an HTTP head and the payload,
    or a revisit with the HTTP head alone. White space and control characters of a url are written as %20."""
    rows = with_revisits(pages, min_bytes)
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END.decode()))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))  # noqa: E731  null without a value
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat_ws(
        "", F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(again, "revisit").otherwise("response")), field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", uri), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), field("X-Page-ID", F.col("page_id").cast("string")),
        F.when(again, field("WARC-Profile", F.lit(PROFILE))), F.when(again, field("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest")))),
        field("X-Refers-To-Page-ID", F.col("refers_to").cast("string")), field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block, F.lit("\r\n")).alias("record"))


def write_streams(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """The records of each partition as one gzip stream in ``folder``, by Spark's text sink."""
    warc_records(pages, min_bytes).write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Inflated:
    """The inflated bytes of a gzip file of one or many members, taken in order; holds a piece at a time."""

    def __init__(self, source):
        self.source, self.member, self.raw, self.have, self.at = source, None, b"", b"", 0

    def more(self) -> bool:
        """One more piece behind what is left of the last; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.source.read(PIECE)
            if not self.raw:
                if self.member is not None:
                    raise ValueError("the gzip stream ends within a member")
                return False
            self.member = self.member or zlib.decompressobj(31)
            piece = self.member.decompress(self.raw, PIECE)
            self.raw = self.member.unconsumed_tail
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, None
            if piece:
                self.have, self.at = self.have[self.at :] + piece, 0
                return True

    def head(self) -> bytes | None:
        """All up to and with the next empty line, or None at the end."""
        seen = self.at
        while (end := self.have.find(END, seen)) < 0:
            left = len(self.have) - self.at
            if left > MOST_HEAD:
                raise ValueError(f"no record head within {MOST_HEAD} bytes")
            if not self.more():
                if left:
                    raise ValueError("the last record has no whole head")
                return None
            seen = max(0, left - len(END) + 1)
        out = self.have[self.at : end + len(END)]
        self.at = end + len(END)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, piece by piece."""
        while n:
            if self.at == len(self.have) and not self.more():
                raise ValueError(f"the last record lacks {n} bytes")
            piece = self.have[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def fields_of(head: bytes) -> dict[str, str]:
    """The named fields of a record's or HTTP head, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def normalise_stream(source, archive, level: int = 6) -> Iterator[dict]:
    """Writes every record of the gzip stream ``source`` to ``archive`` as a member of its own and yields its index entry.
    No record is held whole. A stream or record that breaks off, or bytes that are no record, raise ValueError."""
    stream, offset = Inflated(source), 0
    while (head := stream.head()) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {head[:40]!r}")
        fields = fields_of(head)
        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)  # no name and no time in the head, so a task run again writes the same
        length = archive.write(deflate.compress(head))
        for piece in stream.take(int(fields["content-length"])):
            length += archive.write(deflate.compress(piece))
        if b"".join(stream.take(len(END))) != END:
            raise ValueError(f"{fields.get('warc-record-id')} does not end where its length says")
        length += archive.write(deflate.compress(END) + deflate.flush())
        yield {"offset": offset, "length": length, "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "page_id": _number(fields.get("x-page-id")), "uri": fields.get("warc-target-uri")}
        offset += length


def normalise_file(uri: str, folder: str, level: int = 6) -> tuple[str, int, int]:
    """Normalises the file ``uri`` into ``folder``; the archive's name, records and bytes.

    Archive and index are written under names of this attempt and moved once whole, the index last: an index that is
    there has its archive, and attempts that were lost or run twice leave the same files.
    """
    fs, path = _place(uri)
    out, base = _place(folder)
    name = path.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".txt").removesuffix(".warc") + ".warc.gz"
    mark = f"{base}/_{uuid.uuid4().hex}"
    records = size = 0
    with fs.open_input_stream(path, compression=None) as source, out.open_output_stream(f"{mark}.gz", compression=None) as archive, out.open_output_stream(f"{mark}.idx", compression=None) as index:
        for entry in normalise_stream(source, archive, level):
            index.write((json.dumps({"archive": name} | entry) + "\n").encode())
            records, size = records + 1, size + entry["length"]
    out.move(f"{mark}.gz", f"{base}/{name}")
    out.move(f"{mark}.idx", f"{base}/{name}.idx")
    return name, records, size


def normalise(spark: SparkSession, streams: str, folder: str, level: int = 6) -> DataFrame:
    """(archive, records, bytes) of every gzip file in ``streams``, each normalised into ``folder`` within one task.

    Spark lists the files and deals them to tasks by size; their bytes are read by the task, never through a row. Both
    folders must be open to all executors.
    """
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    out, base = _place(folder)
    out.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [normalise_file(p, folder, level) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)] if done else [pa.array([], t) for t in schema.types], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(streams).select("path")
    return checkpointed(files.mapInArrow(run, "archive string, records long, bytes long"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of all archives in ``folder``."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


def parse_member(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record fields, HTTP fields, payload) of one record's gzip member."""
    whole = zlib.decompress(member, 31)
    head = whole.index(END) + len(END)
    fields = fields_of(whole[:head])
    block = whole[head : head + int(fields["content-length"])]
    http = block.find(END) + len(END)
    return fields, fields_of(block[:http]), block[http:]


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS, and the payload as binary unless ``payloads`` is false, of the entries of ``index`` in ``folder``.

    Each record is read by its offset and length alone, so any part of an index may be asked for. Digest and length of a
    response are those of the bytes read, and ``intact`` tells whether they agree with the record's head; a revisit has
    them from its heads, and a null payload. A record is held whole while it is parsed.
    """
    schema = pa.schema([
        ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("intact", pa.bool_()), *([("payload", pa.binary())] if payloads else []),
    ])

    def row(archive: str, offset: int, member: bytes) -> tuple:
        fields, http, payload = parse_member(member)
        kind, said, size = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:"), _number(http.get("content-length"))
        digest, n, intact, body = said, size, True, None
        if kind == "response":
            digest, n, body = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), payload
            intact = digest == said and n == size
        found = (archive, offset, _number(fields.get("x-page-id")), fields.get("warc-target-uri"), kind, _number(fields.get("x-refers-to-page-id")), n, digest, intact)
        return (*found, body) if payloads else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{base}/{archive}")
                rows.append(row(archive, offset, file.read_at(length, offset)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    bound_batches(index.sparkSession)
    return index.select("archive", "offset", "length").mapInArrow(run, RECORDS + (", payload binary" if payloads else ""))


def archived(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """RECORDS of ``pages`` (page_id, url, html, any others), written to ``folder``, normalised and read back.

    One record for each row. Null html is an empty payload, which counts as equal to other empty ones. Null urls have no
    target, null page_ids no id. No rows: no records. Archives stay in ``folder``/warc; the streams are deleted once all are
    normalised.
    """
    spark = pages.sparkSession
    write_streams(pages, f"{folder}/streams", min_bytes)
    normalise(spark, f"{folder}/streams", f"{folder}/warc")
    fs, path = _place(f"{folder}/streams")
    fs.delete_dir(path)
    return read_records(read_index(spark, f"{folder}/warc"), f"{folder}/warc", payloads=False)
