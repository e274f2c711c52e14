"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file gives the machines: a normaliser (space to the visible mark, a mark in front), a trie of pieces whose
arcs end at each piece, byte fallback for characters that no piece has, and a junction machine that weighs piece b after
piece a. For unigram models arcs cost the negated scores and junctions nothing. For byte-pair models arcs cost nothing and
a junction costs nothing if the merges of a+b keep that cut, and infinitely much otherwise. Composed with an input they
give a lattice whose states are places and last pieces; its least-cost path in the tropical semiring (costs add along a
path, the least path counts) is the encoding, found by settling states in order of cost.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from roadloom.llm.common import bound_batches

MARK = "▁"
#: Words, or junctions, that a worker remembers.
MEMO = 250_000


class Memo(dict):
    """Remembers what ``make`` gives for at least the last ``limit`` different keys and at most twice as many."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[at]
            out, shift, at = out | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return out, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = (number(at)) if kind == 2 else ({5: 4, 1: 8}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Transducer:
    """Compiled once from a model file and composed with texts."""

    def __init__(self, path: str, memo: int = MEMO):
        raw = open(path, "rb").read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        spec, model_type = {}, 1
        for field, value in _fields(raw):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8", "replace"))
                scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                self.kinds.append(own.get(3, 1))
            elif field == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif field == 3:
                spec = dict(_fields(value))
        if spec.get(2):
            raise ValueError("this normaliser has a character map; only identity normalisers are compiled")
        self.prefix, self.strip, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.bpe = model_type == 2
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (1, 4)}
        self.score = scores
        self.bytes_ = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        self.width = max(map(len, self.ids), default=1)
        # A mark after another character starts a segment of its own if no piece crosses that place.
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        #: A node of the trie of pieces has its children by character and, under "", the id that ends there.
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        # Two characters that no piece has side by side are a place that no piece crosses.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.fallback_cost = 10.0 - min(scores, default=0.0)
        self.id_bytes = [np.uint32(i).tobytes() for i in range(len(self.pieces))]
        #: Whether piece b may follow piece a, which is None at the start and after fallback.
        self.junctions = Memo(self._passes, 2 * memo)
        self.parts = Memo(self.shortest_path, memo)
        self.words = Memo(lambda w: self._segment(MARK + w), memo)
        self.spelt = [self._spelling(i) for i in range(len(self.pieces))]

    def _passes(self, ids: tuple[int | None, int]) -> bool:
        own = [self.pieces[i] for i in ids if i is not None]
        return self._merged("".join(own)) == own

    def _spelling(self, i: int) -> bytes:
        """What an id gives back: a byte, the sign of an unknown piece, nothing for control ids, else the piece."""
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        own = {2: " ⁇ ", 3: ""}.get(self.kinds[i], self.pieces[i])
        return (own.replace(MARK, " ") if self.escape else own).encode()

    def normalise(self, text: str) -> str:
        if self.strip:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        return text.replace(" ", MARK) if self.escape else text

    def _merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text, best score first, then leftmost."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if both in self.ids:
                heapq.heappush(heap, (-self.score[self.ids[both]], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both or after[i] != j:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _arcs(self, text: str, at: int) -> list[tuple[int | None, int, float]]:
        """(id, end, cost) of the arcs that leave a place, found on one walk down the trie of pieces; None stands for byte
        fallback, where no piece has the character."""
        out, node, free, end = [], self.trie, self.bpe, at
        for c in text[at : at + self.width]:
            node = node.get(c)
            if node is None:
                break
            end += 1
            i = node.get("")
            if i is not None:
                out.append((i, end, 0.0 if free else -self.score[i]))
        if not out or out[0][1] > at + 1:
            out.append((None, at + 1, self.fallback_cost))
        return out

    def shortest_path(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit numbers, on the least-cost path of the composed lattice.

        A state is a place and the last piece, which only junctions of byte-pair models tell apart. States are settled by
        cost, of equal costs the farthest place first. No weight is negative, so the first path to settle the end is a
        least one, and a junction need only be weighed when its arc comes to the front: until then its cost is a bound.
        """
        n, bpe, arcs, junctions = len(text), self.bpe, self._arcs, self.junctions
        push, pop, settled = heapq.heappush, heapq.heappop, set()
        # (cost without the junction, place from its end, order of arrival, place before, last id, id, path before)
        heap: list[tuple] = []
        at, count, last, path, cost = 0, 0, None, (), 0.0
        while at < n:
            for i, end, weight in arcs(text, at):
                count += 1
                push(heap, (cost + weight, -end, count, at, last, i, path))
            while heap:
                cost, rest, _, before, prior, i, path = pop(heap)
                state = (rest, i) if bpe else rest
                if state not in settled and not (bpe and i is not None and not junctions[prior, i]):
                    settled.add(state)
                    break
            else:
                raise ValueError(f"the machines give no path for {text!r}")
            at, last, path = -rest, i, (path, before, i)
        steps = []
        while path:
            path, before, i = path
            steps.append(self.id_bytes[i] if i is not None else self._fallback(text[before]))
        return b"".join(reversed(steps))

    def _fallback(self, character: str) -> bytes:
        if not self.bytes_:
            return self.id_bytes[self.unknown]
        return b"".join([self.id_bytes[self.bytes_[x]] for x in character.encode("utf-8", "replace")])

    def _segments(self, text: str) -> list[str]:
        """Pieces of a normalised text between places that no piece crosses."""
        if not self.cuts:
            return [text] if text else []
        parts = text.split(MARK)
        if len(parts) == 1:
            return parts if text else []
        out = [parts[0]] if parts[0] else []
        marks = 0
        for p in parts[1:]:
            marks += 1
            if p:
                out.append(MARK * marks + p)
                marks = 0
        return out + ([MARK * marks] if marks else [])

    def _segment(self, seg: str) -> bytes:
        """The shortest path, put together from those between places that no piece crosses: a lattice has one state there
        but for the last piece, and no junction weighs characters that no piece joins."""
        joined, start, out = self.joined, 0, b""
        for k in range(1, len(seg)):
            if seg[k - 1 : k + 1] not in joined:
                out += self.parts[seg[start:k]]
                start = k
        return out + self.parts[seg[start:]]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if self.cuts and self.prefix and self.escape and text and MARK not in text and "  " not in text and text[0] != " " != text[-1]:
            return b"".join(map(self.words.__getitem__, text.split(" ")))  # each word has its mark in front
        return b"".join([self._segment(x) for x in self._segments(self.normalise(text))])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The inverse machine: bytes gather to characters (malformed ones become U+FFFD), marks to spaces, the first
        mark goes if the normaliser put it there."""
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode_documents(docs: DataFrame, model: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_ids, n_bytes, ids_crc32, decoded_equal), a row for each row of ``docs`` (doc_id, text, any others).

    n_bytes counts byte-fallback ids; ids_crc32 is over little-endian unsigned 32-bit ids; decoded_equal says whether
    decoding gives back the text, which only a text that holds the visible mark itself can fail. Null and empty texts
    have no ids. Without ``keep_ids`` the ids stay in the task. Nothing is shuffled and no text is cut.
    """
    bound_batches(docs.sparkSession)
    path = model or default_model_path()
    fields = [("doc_id", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if keep_ids else []) + [("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_equal", pa.bool_())]
    ddl = "doc_id long, " + ("ids array<int>, " if keep_ids else "") + "n_ids long, n_bytes long, ids_crc32 long, decoded_equal boolean"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        byte_ids = np.zeros(len(fst.pieces), bool)
        byte_ids[list(fst.byte_of)] = True
        for batch in batches:
            rows, raws, ends = [], [], [0]
            for text in batch.column(1):
                text = text.as_py() or ""
                raw = fst.encode_bytes(text)
                a = np.frombuffer(raw, "<u4")
                rows.append((len(a), int(byte_ids[a].sum()), zlib.crc32(raw), fst.decode(a.tolist()) == text))
                ends.append(ends[-1] + len(a))
                if keep_ids:
                    raws.append(raw)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            ids = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raws), "<i4")))] if keep_ids else []
            own = [pa.array(c, f.type) for c, f in zip(cols, list(schema)[-4:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *ids, *own], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give a null text."""
    path = model or default_model_path()

    @arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        fst = transducer(path)
        return pa.array([None if x is None else fst.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.select("doc_id", text_of("ids").alias("text"))
