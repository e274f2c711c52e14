"""WARC: round trips through whole-file streams, members read alone, damaged input."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib

import pyarrow as pa
import pytest

from roadloom.llm import warc as W

PAGES = "page_id long, url string, html string, record string, archive int"


def fixture():
    same = "<p>Grüße\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [
        (5, "http://a.example/x", same), (3, "http://a.example/y z\r\nX: 1", same), (9, None, same), (1, "http://b.example/", None), (2, "http://b.example/2", ""), (7, "http://c.example/", "日本" * 400_000),
        (8, "u", "tail\r\n\r\n"), (8, "u", "tail\r\n\r\n"), (10, "v", "tail\r\n\r\n"), (None, "w", "tail\r\n\r\n"), (None, "w", "own"), (None, "w", "own"), (11, "x", "\x00\x1f\x8b one"),
    ]
    return [(*r, "clash", 1) for r in rows]


def expected(rows, least=0):
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        to = first.get(html or "") if len(raw) >= least else None
        to = None if to == page else to
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to, True))
    return out


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(fixture(), PAGES).repartition(3)
    got = W.archived(pages, str(tmp_path), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected(fixture(), least)))


def test_members_stand_alone_and_hold_the_payload(spark, tmp_path):
    W.write_streams(spark.createDataFrame(fixture(), PAGES).coalesce(1), f"{tmp_path}/streams")
    streams = list((tmp_path / "streams").glob("*.gz"))
    for stream in streams:  # one member for the whole file
        whole = zlib.decompressobj(31)
        whole.decompress(stream.read_bytes())
        assert whole.eof and not whole.unused_data
    done = W.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/warc").collect()
    assert sum(r.records for r in done) == len(fixture())
    entries = [json.loads(x) for p in (tmp_path / "warc").glob("*.idx") for x in p.read_text().splitlines()]
    joined = b"".join(gzip.decompress(s.read_bytes()) for s in streams)
    members = []
    for e in entries:
        raw = (tmp_path / "warc" / e["archive"]).read_bytes()[e["offset"] : e["offset"] + e["length"]]
        member = zlib.decompressobj(31)
        members.append(member.decompress(raw))
        assert member.eof and not member.unused_data and members[-1].startswith(b"WARC/1.1\r\n")
    assert b"".join(members) == joined
    assert {p.name for p in (tmp_path / "warc").iterdir() if not p.name.startswith(".")} == {e["archive"] for e in entries} | {e["archive"] + ".idx" for e in entries}
    index = W.read_index(spark, f"{tmp_path}/warc")
    rows = W.read_records(index.where("page_id in (7, 8)"), f"{tmp_path}/warc").collect()
    assert sorted((r.page_id, r.payload.decode()) for r in rows) == [(7, "日本" * 400_000), (8, "tail\r\n\r\n"), (8, "tail\r\n\r\n")]
    assert {r.uri for r in index.where("page_id = 3").collect()} == {"http://a.example/y%20z%20%20X:%201"}
    # what is normalised already, or was lost half way, comes out the same
    W.normalise(spark, f"{tmp_path}/warc", f"{tmp_path}/again")
    for p in (tmp_path / "warc").glob("*.gz"):
        assert p.read_bytes() == (tmp_path / "again" / p.name).read_bytes()


def test_damage_is_seen(spark, tmp_path, monkeypatch):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    run = lambda raw: list(W.normalise_stream(io.BytesIO(raw), io.BytesIO()))
    monkeypatch.setattr(W, "PIECE", 7)
    assert [e["record_id"] for e in run(gzip.compress(record * 3))] == ["<a>"] * 3 and run(b"") == run(gzip.compress(b"")) == []
    assert [e["offset"] for e in run(gzip.compress(record) + gzip.compress(record))][0] == 0
    for raw in (gzip.compress(record)[:-9], gzip.compress(record[:-2]), gzip.compress(record[:-6] + END_OF), gzip.compress(b"HTTP/1.1 200\r\n\r\n"), gzip.compress(record + b"WARC/1.1\r\nWARC")):
        with pytest.raises(ValueError):
            run(raw)
    with pytest.raises(zlib.error):
        run(b"no gzip at all")
    out = pa.BufferOutputStream()
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\r\n\r\n"
    entry = next(W.normalise_stream(io.BytesIO(gzip.compress(bad)), out))
    (tmp_path / "x.warc.gz").write_bytes(out.getvalue().to_pybytes())
    index = spark.createDataFrame([("x.warc.gz", entry["offset"], entry["length"])], "archive string, offset long, length long")
    assert not W.read_records(index, str(tmp_path)).first().intact


END_OF = b"\r\n"


def test_no_pages(spark, tmp_path):
    assert W.archived(spark.createDataFrame([], PAGES), str(tmp_path)).count() == 0
