"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become ids in one pass and leave it as short piece records. Pieces that fill a sequence alone are done.
The others are dealt at random into blocks of a few thousand; each block is evolved by several islands that swap their
best solutions, and what its poorly filled sequences hold is dealt anew and evolved again.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import bound_batches
from roadloom.session import checkpointed

CAPACITY, END_ID = 1024, 2
#: Pieces of a block; islands of a block; solutions of an island; migrations; generations between migrations; generations
#: without a gain after which an island rests until the next migration.
BLOCK_ITEMS, ISLANDS, POPULATION, EPOCHS, GENERATIONS, PATIENCE = 4096, 2, 6, 3, 24, 8

_encoders: dict = {}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the pre-tokeniser's pattern of the public byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of whole texts under a vocabulary file of the ``tokenizers`` library.

    Where the file is plain byte-level BPE whose ids rise with the order of the merges, merging by least id is merging by
    first merge, and ``tiktoken`` does that several times faster over the same vocabulary. Texts that hold a special
    token's string, and files of another kind, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain_file = model.get("type") == "BPE" and spec.get("normalizer") is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain_file or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        # Byte-level BPE spells byte b as a printable character: itself where it is one, else 256 and up in turn.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        byte_of = {chr(b if b in plain else next(spare)): b for b in range(256)}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            return None
        return tiktoken.Encoding(path, pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each row of ``docs``.

    A text's ids end with END_ID; a null text is empty. Up to ``capacity`` ids are one piece; longer texts are cut into
    pieces of ``capacity`` of which the first may be shorter. uid tells pieces apart even if doc_ids repeat.
    """
    fields = [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = _encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, stop, piece = 0, n % capacity or capacity, 0
                while start < n:
                    own = ids[4 * start : 4 * stop]
                    rows.append((uid, doc_id, piece, start, stop - start, zlib.crc32(own)) + ((np.frombuffer(own, "<u4").astype(np.int32),) if keep_ids else ()))
                    uid, start, stop, piece = uid + 1, stop, stop + capacity, piece + 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


class _Solution:
    """bins: lists of item indexes; a grouping, whatever the bins' order."""

    def __init__(self, bins: list[list[int]], lengths: list[int]):
        self.bins = bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]

    @property
    def fitness(self) -> tuple[int, int]:
        return len(self.bins), -sum(f * f for f in self.fill)


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Each item, in the order given, into the bin that it fills most closely, else into a new one."""
    by_room: dict[int, list[int]] = {}
    open_ = 0  # bit r is set if a bin has r places left
    for k, f in enumerate(fill):
        by_room.setdefault(capacity - f, []).append(k)
        open_ |= 1 << (capacity - f)
    for i in items:
        n = lengths[i]
        able = open_ >> n
        if able:
            room = n + (able & -able).bit_length() - 1
            here = by_room[room]
            k = here.pop()
            if not here:
                open_ &= ~(1 << room)
            bins[k].append(i)
            fill[k] += n
        else:
            k, room = len(bins), capacity
            bins.append([i])
            fill.append(n)
        room -= n
        by_room.setdefault(room, []).append(k)
        open_ |= 1 << room


def _fresh(lengths: list[int], capacity: int, rng: random.Random, noise: float) -> _Solution:
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i] * (1 + noise * rng.random()), i))
    bins: list[list[int]] = []
    best_fit(order, lengths, bins, [], capacity)
    return _Solution(bins, lengths)


def _dissolve(sol: _Solution, gone: set[int], first: list[list[int]], lengths: list[int], capacity: int, noise=lambda: 0.0) -> _Solution:
    """``first`` whole, the bins of ``sol`` outside ``gone`` and without items of ``first``, the rest best-fitted by falling
    length, or nearly so with ``noise``."""
    taken = {i for b in first for i in b}
    bins, loose = [list(b) for b in first], []
    for k, b in enumerate(sol.bins):
        if k in gone or not taken.isdisjoint(b):
            loose += [i for i in b if i not in taken]
        else:
            bins.append(list(b))
    fill = [sum(lengths[i] for i in b) for b in bins]
    order = sorted((-lengths[i] * (1 + noise()), i) for i in loose)
    best_fit([i for _, i in order], lengths, bins, fill, capacity)
    return _Solution(bins, lengths)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: for every k up to half the capacity, items longer than capacity - k share a bin with none
    of length k or more, other items over half share with no item over half, and the items from k to half need the room
    that these leave."""
    if not lengths:
        return 0
    a = np.sort(np.asarray(lengths, np.int64))
    total = np.r_[0, np.cumsum(a)]
    half = np.searchsorted(a, capacity / 2, "right")
    best = -(-int(total[-1]) // capacity)
    for k in np.unique(np.r_[0, a[:half]]):
        alone = np.searchsorted(a, capacity - k, "right")
        low = np.searchsorted(a, k, "left")
        over = len(a) - half
        room = (alone - half) * capacity - (total[alone] - total[half]) if alone > half else 0
        need = max(0, int(total[half] - total[low] - room)) if half > low else 0
        best = max(best, over + -(-need // capacity))
    return int(best)


def refill(sol: _Solution, lengths: list[int], capacity: int, tries: int = 64) -> _Solution:
    """The emptiest bins are dissolved, and a dissolved item takes the place of one or two shorter ones wherever the bin
    comes out fuller without running over; what is left over is best-fitted. Short items are the easier to place."""
    order = sorted(range(len(sol.bins)), key=sol.fill.__getitem__)
    gone = set(order[: max(2, len(order) // 50)])
    loose = sorted((i for k in gone for i in sol.bins[k]), key=lambda i: -lengths[i])
    bins = [list(b) for k, b in enumerate(sol.bins) if k not in gone]
    fill = [f for k, f in enumerate(sol.fill) if k not in gone]
    slack = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: -fill[k])[:tries]
    for k in slack:
        own, room = bins[k], capacity - fill[k]
        best = None
        for at, i in enumerate(loose):
            for out in [(j,) for j in own] + [(own[x], own[y]) for x in range(len(own)) for y in range(x)] if len(own) < 12 else [(j,) for j in own]:
                gain = lengths[i] - sum(lengths[j] for j in out)
                if 0 < gain <= room and (best is None or gain > best[0]):
                    best = (gain, at, out)
            if best and best[0] == room:
                break
        if best:
            gain, at, out = best
            own[:] = [j for j in own if j not in out] + [loose[at]]
            loose[at : at + 1] = out
            fill[k] += gain
    best_fit(sorted(loose, key=lambda i: (-lengths[i], i)), lengths, bins, fill, capacity)
    return _Solution(bins, lengths)


def crossover(a: _Solution, b: _Solution, lengths: list[int], capacity: int, rng: random.Random) -> _Solution:
    """The fullest bins of ``b``, some tenth to two thirds of all, are injected whole into ``a``; bins of ``a`` that hold
    the same items go, and the items displaced that way are best-fitted."""
    order = sorted(range(len(b.bins)), key=lambda k: (-b.fill[k], rng.random()))
    picked = order[: max(1, int(len(order) * rng.uniform(0.1, 0.67)))]
    return _dissolve(a, set(), [b.bins[k] for k in picked], lengths, capacity)


def mutate(a: _Solution, lengths: list[int], capacity: int, rng: random.Random) -> _Solution:
    """The emptiest bin and a few others are dissolved and their items best-fitted in an order that is near that of their
    lengths, so that what is dissolved does not come back as it was."""
    worst = min(range(len(a.bins)), key=a.fill.__getitem__)
    gone = {worst} | {rng.randrange(len(a.bins)) for _ in range(max(2, len(a.bins) // 50))}
    width = rng.choice((0.1, 0.5, 2.0))
    return _dissolve(a, gone, [], lengths, capacity, lambda: width * rng.random())


def evolve(lengths: list[int], seeds: list[list[list[int]]], capacity: int, rng: random.Random, generations: int = GENERATIONS, population: int = POPULATION, patience: int = PATIENCE) -> list[_Solution]:
    """The island's solutions, best first. It rests when the best one meets the lower bound, for no packing is better, and
    after ``patience`` generations without a gain. Children are made of two parents, mutated or refilled, and take the
    place of the worst solution if they are no worse or have no more bins than the best."""
    bound = lower_bound(lengths, capacity)
    pop = [_Solution(s, lengths) for s in seeds]
    noise = 0.0
    while len(pop) < population and (not pop or min(s.fitness for s in pop)[0] > bound):
        pop.append(_fresh(lengths, capacity, rng, noise))
        noise = noise * 2 or 0.02
    pop.sort(key=lambda s: s.fitness)
    idle = 0
    for _ in range(generations):
        if pop[0].fitness[0] <= bound or len(pop) < 2 or idle >= patience:
            break
        i, j = rng.sample(range(len(pop)), 2)
        child = crossover(pop[i], pop[j], lengths, capacity, rng)
        child = refill(child, lengths, capacity) if rng.random() < 0.5 else mutate(child, lengths, capacity, rng)
        idle = 0 if child.fitness < pop[0].fitness else idle + 1
        if child.fitness <= pop[-1].fitness or len(child.bins) <= len(pop[0].bins):  # equals are let in: they differ inside
            pop[-1] = child
            pop.sort(key=lambda s: s.fitness)
    return pop


def _assign(sol: _Solution, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(sol.bins):
        for i in b:
            out[i] = k
    return out


def _bins(assign: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(assign, default=-1) + 1)]
    for i, k in enumerate(assign):
        bins[k].append(i)
    return [b for b in bins if b]


_ISLAND = "block long, island int, uids array<long>, lengths array<int>, solutions array<array<int>>"


def _epoch(islands: DataFrame, capacity: int, seed: int, epoch: int) -> DataFrame:
    """Every island, one row each, evolves on its own."""

    def run(batches):
        for pdf in batches:
            out = []
            for block, island, lengths, given in zip(pdf["block"], pdf["island"], pdf["lengths"], pdf["solutions"], strict=True):
                rng = random.Random(f"{seed}/{block}/{island}/{epoch}")
                lens = [int(x) for x in lengths]
                pop = evolve(lens, [_bins([int(x) for x in s]) for s in given], capacity, rng)
                out.append([np.array(_assign(s, len(lens)), np.int32) for s in pop])
            yield pdf.assign(solutions=out)

    return islands.mapInPandas(run, _ISLAND)


def _pack_round(items: DataFrame, n_items: int, capacity: int, block_items: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(block, bin, uid, length) of items (uid, length)."""
    n_blocks = max(1, -(-n_items // block_items))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n_blocks)))
    blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("own"))
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("own.uid").alias("uids"), F.col("own.length").cast("array<int>").alias("lengths"), F.array().cast("array<array<int>>").alias("solutions"))
    # Each island is a row of its own key, so that the islands of a block evolve in different tasks.
    state = state.repartition("block", "island")
    for epoch in range(epochs):
        state = checkpointed(_epoch(state, capacity, seed, epoch))
        if epoch + 1 < epochs:
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("solutions")[0].alias("elite"))
            state = state.join(elite, ["block", "island"]).select("block", "island", "uids", "lengths", F.concat(F.array("elite"), F.slice("solutions", 1, POPULATION - 1)).alias("solutions"))
    ranked = state.select("block", "uids", "lengths", F.col("solutions")[0].alias("best"))
    best = ranked.groupBy("block").agg(F.min_by(F.struct("uids", "lengths", "best"), F.struct(F.array_max("best"), F.hash("best"))).alias("b"))
    flat = best.select("block", F.explode(F.arrays_zip("b.uids", "b.lengths", "b.best")).alias("z"))
    return flat.select("block", F.col("z.best").alias("bin"), F.col("z.uids").alias("uid"), F.col("z.lengths").cast("long").alias("length"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length): no sequence holds more than ``capacity``.

    A block is a fixed number of pieces, so the work grows with the pieces and no task with the corpus. Sequences below
    95 % full are taken apart and packed again across blocks, as long as that makes them fewer; packing that does not is
    dropped. Pieces of equal length are interchangeable; ties go by uid.
    """
    small = checkpointed(pieces.where(F.col("length") < capacity).select("uid", F.col("length").cast("long").alias("length")))
    full = pieces.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    now, settled, turn = checkpointed(_pack_round(small, small.count(), capacity, block_items, islands, epochs, seed)), [], 0
    while True:
        number = ((F.col("block") * (1 << 20) + F.col("bin")) * 64 + turn).alias("sequence_id")
        poor = now.groupBy("block", "bin").agg(F.sum("length").alias("filled")).where(F.col("filled") * 100 < capacity * 95).select("block", "bin", F.lit(True).alias("poor"))
        marked = checkpointed(now.join(poor, ["block", "bin"], "left"))
        bins = marked.where("poor").select("block", "bin").distinct().count()
        again = marked.where("poor").select("uid", "length")
        # Fewer than two sequences cannot become fewer; the turn's number has six bits.
        found = checkpointed(_pack_round(again, again.count(), capacity, block_items, islands, epochs, seed + turn + 1)) if bins > 1 and turn < 63 else None
        if found is None or found.select("block", "bin").distinct().count() >= bins:
            settled.append(marked.select("uid", "length", number))
            break
        settled.append(marked.where("poor is null").select("uid", "length", number))
        now, turn = found, turn + 1
    placed = settled[0]
    for part in settled[1:]:
        placed = placed.union(part)
    # A sequence holds at most ``capacity`` pieces, so its window is small whatever the data.
    listed = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("own"))
    starts = F.transform(F.sequence(F.lit(1), F.size("own")), lambda k: F.aggregate(F.slice("own", 1, k - 1), F.lit(0).cast("long"), lambda a, x: a + x["length"]))
    packed = listed.select("sequence_id", F.explode(F.arrays_zip(F.col("own.uid").alias("uid"), starts.alias("offset"))).alias("z")).select("z.uid", "sequence_id", "z.offset")
    return packed.unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, seed: int = 7) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of each row of ``docs``.

    Null and empty texts are a piece of one id. Rows that repeat a doc_id are packed as documents of their own. No rows:
    no rows. ids_crc32 is over the piece's ids as little-endian unsigned 32-bit numbers.
    """
    pieces = checkpointed(pieces_of(docs, tokenizer or default_tokenizer_path(), capacity))
    return pieces.join(pack(pieces, capacity, block_items, seed=seed), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
