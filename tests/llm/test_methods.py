"""The methods behind the corpus operators: order by cost, gains of the genetic algorithm, the lattice search, awkward JSON."""

from __future__ import annotations

import random
import re
import struct
import sys
import time
from collections import Counter, defaultdict

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from roadloom.llm import packing as P
from roadloom.llm import sharding
from roadloom.llm import queries as Q
from roadloom.llm.common import bound_batches, bytes_of
from roadloom.llm.line_dedup import line_dedup
from roadloom.llm.quality_classifier import train
from roadloom.llm.quality_rules import Rule, base_rules, default_rules, order_rules, rule_costs
from roadloom.llm.sentencepiece_fst import Transducer
from roadloom.llm.sharding import rows_before, shuffled_shards
from roadloom.llm.simhash import near_edges
from roadloom.llm.text_stats import TextFacts
from roadloom.llm.tool_calls import levels_of, link_tool_calls
from roadloom.llm.url_filter import rule_labelled, url_filter

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module

SF = "/root/testdata/sf0.001"
CALLS = "conv_id string, call_id string, name string, arguments string, depends_on array<string>, status int"


def wait(seconds: float):
    def test(facts):
        until = time.perf_counter() + seconds
        while time.perf_counter() < until:
            pass
        return len(facts.text) % 2 == 0

    return test


def test_rules_are_ordered_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(60)], "doc_id long, text string")
    rules = [Rule("dear", wait(0.002)), Rule("never", lambda f: False), Rule("cheap", wait(0.0002)), Rule("rare", lambda f: wait(0.0002)(f) and len(f.text) % 20 == 0)]
    cost = rule_costs(docs, rules)
    assert cost["dear"][0] > 5 * cost["cheap"][0] and cost["dear"][1:] == cost["cheap"][1:] == (30, 60) and cost["rare"][1] == 3
    assert [r.name for r in order_rules(docs, rules)] == ["cheap", "dear", "rare", "never"]
    assert [r.name for r in order_rules(docs.limit(0), rules)] == [r.name for r in rules]


def test_facts_are_made_only_when_a_rule_asks():
    facts = TextFacts("## one\n## one")
    assert default_rules()[0].rejects(facts) and "n_repeat_words" not in vars(facts) and "n_capitals" not in vars(facts)
    assert TextFacts(None).counts() == (0, 0, 0, 0, 0) and base_rules()[0].rejects(TextFacts(None))


def triplets(n: int, seed: int) -> list[int]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    return out


def test_the_genetic_algorithm_beats_best_fit():
    won = 0
    for seed in range(6):
        lengths = triplets(4, seed)  # four full bins hold these twelve, and fewer cannot
        first = P._fresh(lengths, 1000, random.Random(0), 0.0)
        best = P.evolve(lengths, [], 1000, random.Random(seed), generations=600, patience=600)[0]
        assert sorted(i for b in best.bins for i in b) == list(range(12)) and max(best.fill) <= 1000
        assert 4 <= len(best.bins) <= len(first.bins)
        won += len(best.bins) == 4 < len(first.bins)
    assert won >= 3
    lengths = [random.Random(9).randint(250, 500) for _ in range(1)] + [random.Random(k).randint(250, 500) for k in range(599)]
    first = P._fresh(lengths, 1024, random.Random(0), 0.0)
    assert len(P.evolve(lengths, [], 1024, random.Random(1))[0].bins) < len(first.bins)


def test_crossover_and_mutation_keep_every_item_and_full_bins():
    lengths, rng = triplets(30, 3), random.Random(4)
    a, b = P._fresh(lengths, 1000, rng, 0.3), P._fresh(lengths, 1000, rng, 0.3)
    for child in (P.crossover(a, b, lengths, 1000, rng), P.mutate(a, lengths, 1000, rng), P.refill(a, lengths, 1000)):
        assert sorted(i for x in child.bins for i in x) == list(range(90)) and max(child.fill) <= 1000
        assert child.fill == [sum(lengths[i] for i in x) for x in child.bins]
    fullest = max(range(len(b.bins)), key=b.fill.__getitem__)
    assert sorted(b.bins[fullest]) in [sorted(x) for x in P.crossover(a, b, lengths, 1000, rng).bins]


def brute_bins(lengths: tuple[int, ...], capacity: int) -> int:
    best = len(lengths)

    def place(k: int, fill: list[int]) -> None:
        nonlocal best
        if len(fill) >= best:
            return
        if k == len(lengths):
            best = len(fill)
            return
        for j in range(len(fill)):
            if fill[j] + lengths[k] <= capacity:
                place(k + 1, fill[:j] + [fill[j] + lengths[k]] + fill[j + 1 :])
        place(k + 1, [*fill, lengths[k]])

    place(0, [])
    return best


def test_lower_bound_and_evolution_meet_brute_force():
    rng = random.Random(7)
    for _ in range(25):
        lengths = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
        least = brute_bins(tuple(lengths), 20)
        assert P.lower_bound(lengths, 20) <= least
        assert len(P.evolve(lengths, [], 20, rng, generations=200, patience=200)[0].bins) == least


def _field(number: int, kind: int, payload: bytes) -> bytes:
    size = b"" if kind != 2 else bytes([len(payload)]) if len(payload) < 128 else bytes([len(payload) & 127 | 128, len(payload) >> 7])
    return bytes([number << 3 | kind]) + size + payload


def unigram_file(path) -> dict[str, float]:
    """A hand-made unigram model with byte fallback and no character map."""
    pieces = {"▁": -2.0, "a": -3.0, "b": -3.5, "c": -4.0, "ab": -3.2, "bc": -4.5, "abc": -7.0, "▁a": -2.5, "▁ab": -5.5, "ca": -3.9, "aa": -6.5}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, s, 1) for p, s in pieces.items()]
    out = b""
    for text, score, kind in rows:
        own = _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, bytes([kind]))
        out += _field(1, 2, own)
    trainer = _field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7]) + b"\x01"  # unigram, byte fallback
    spec = _field(1, 2, b"identity") + _field(3, 0, b"\x01") + _field(4, 0, b"\x00") + _field(5, 0, b"\x01")
    path.write_bytes(out + _field(2, 2, trainer) + _field(3, 2, spec))
    return pieces


def test_unigram_models_take_the_least_cost_path(tmp_path):
    import sentencepiece

    pieces = unigram_file(tmp_path / "u.model")
    fst = Transducer(str(tmp_path / "u.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("aabbcc é") for _ in range(rng.randint(0, 12)))
        assert fst.encode(text) == sp.encode(text) and fst.decode(fst.encode(text)) == sp.decode(sp.encode(text))

    def least(t: str) -> float:
        return min((least(t[len(p) :]) - s for p, s in pieces.items() if t.startswith(p)), default=float("inf")) if t else 0.0

    for text in ("abc", "aabca", "bcab"):
        cost = -sum(pieces[fst.pieces[i]] for i in fst.encode(text))
        assert cost == pytest.approx(least("▁" + text), abs=1e-4)


def test_json_that_canonical_form_cannot_carry_is_no_json(spark):
    bad = ['{"limit":1e999,"query":"q"}', '{"query":"\\ud800","limit":1}', '{"limit":NaN,"query":"q"}', "[" * 100_000, '{"a":' + "9" * 5000 + "}", '{"\\udfff":1}']
    good = '{"query":"\\ud83c\\udf89","limit":2}'
    calls = spark.createDataFrame([("c", str(i), "search", a, None, 1) for i, a in enumerate([*bad, good])], CALLS)
    results = spark.createDataFrame([], "call_id string, content string")
    rows = {r["call_id"]: r for r in link_tool_calls(calls, results, Q.TOOL_SCHEMAS).collect()}
    assert [rows[str(i)]["errors"] for i in range(len(bad))] == ["no JSON"] * len(bad)
    assert rows[str(len(bad))]["valid"] and '"query":"🎉"' in rows[str(len(bad))]["json"]


def test_ids_of_a_conversation_and_repeats(spark):
    calls = [("p", "1", "search", '{"query":"a","limit":1}', [], 0), ("p", "2", "search", '{"query":"b","limit":1}', ["1", "9"], 0), ("q", "1", "fetch", '{"query":"c"}', ["1"], 0), ("q", "3", "fetch", '{"query":"d"}', ["2"], 0)]
    calls += [("p", "1", "search", '{"query":"z","limit":1}', [], 0), ("p", "1", "search", '{"query":"z","limit":1}', [], 0), (None, None, "fetch", '{"query":"e"}', ["1"], 0), ("p", None, "fetch", "{}", None, 0), (None, "1", "fetch", "{}", None, 0)]
    results = [("p", "1", "r"), ("p", "1", "s"), ("q", "1", None), (None, None, "n"), (None, None, "m"), ("z", "1", "o")]
    cdf, rdf = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id string, call_id string, content string")
    rows = link_tool_calls(cdf, rdf, Q.TOOL_SCHEMAS, repeats=True).collect()
    by = {(r["conv_id"], r["call_id"], r["status"]): r for r in rows}
    assert by["p", "1", "linked"]["n_calls"] == 3 and by["p", "1", "linked"]["n_results"] == 2 and by["p", "1", "linked"]["level"] == 0
    assert by["p", "2", "pending"]["level"] == 1 and by["p", "2", "pending"]["missing_deps"] == 1
    assert by["q", "1", "linked"]["level"] is None and by["q", "3", "pending"]["missing_deps"] == 1 and by["q", "3", "pending"]["level"] == 0
    assert by["p", "1", "repeat_call"]["n_calls"] == 2 and '"z"' in by["p", "1", "repeat_call"]["json"] and '"s"' in by["p", "1", "repeat_result"]["json"]
    assert by["z", "1", "orphan"]["n_results"] == 1 and by[None, "1", "pending"]["level"] == 0
    assert sorted(r["json"] for r in rows if r["status"] == "no_id") == sorted(['{"arguments":{"query":"e"},"id":null,"name":"fetch","result":null}', '{"arguments":{},"id":null,"name":"fetch","result":null}', '{"id":null,"result":"m"}', '{"id":null,"result":"n"}'])
    far = link_tool_calls(cdf, rdf, Q.TOOL_SCHEMAS, local_calls=1, repeats=True).collect()
    assert Counter(map(str, far)) == Counter(map(str, rows))  # longer conversations are ordered by joins alike


def test_levels_equal_a_plain_recursion():
    rng = random.Random(5)
    ids = [str(i) for i in range(60)]
    deps = [[str(j) for j in rng.sample(range(i), min(i, rng.randint(0, 4)))] + (["gone"] if i % 7 == 0 else []) for i in range(60)]
    plain: dict[str, int] = {}
    for i, d in zip(ids, deps, strict=True):
        plain[i] = max((plain[x] + 1 for x in d if x in plain), default=0)
    assert levels_of(ids, deps) == [plain[i] for i in ids]
    assert levels_of(["a", "b", "c", "d"], [["b"], ["a"], ["a"], []]) == [None, None, None, 0]


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "Example.COM", "a.example.net", "net", "xnet", "b.org", "org", "notexample.com", ""]
    paths = ["/en/", "/en/7", "/en", "/de/8x", "/de/", "/es/1", "", "/x"]
    urls = [rng.choice(["http", "HTTPS", ""]) + rng.choice(["://", "://", ":/"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#f"]) for _ in range(400)] + ["http://" + "h" * 50_000 + ".com/en/" + "p" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter(pages, Q.URL_RULES, rule_labelled(pages.limit(0), Q.URL_RULES)).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in Q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.text)
        assert got[i]["verdict"] == (best.verdict if best else "allow")


def test_repeated_rows_scatter_and_counts_add_up(spark):
    docs = spark.createDataFrame([(1, "same")] * 500 + [(None, None)] * 40, "doc_id long, text string").repartition(4)
    rows = shuffled_shards(docs, shards=3, bucket_bytes=200).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter({(1, "same"): 500, (None, None): 40})
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(180)) for s in slots.values())
    counts = spark.createDataFrame([(b, b % 5 + 1) for b in range(0, 20_000, 3)], "bucket long, n long")
    before, total = {r["bucket"]: r["before"] for r in rows_before(counts).collect()}, 0
    for b in range(0, 20_000, 3):
        assert before[b] == total
        total += b % 5 + 1


def test_the_sample_stays_bounded_where_an_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, "Some words here.") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert train(docs, labels, F.lit(False), max_positives=2, max_unlabelled=5).prior > 0


@pytest.mark.parametrize("place_rows", [20_000, 3])
def test_near_edges_of_dense_families(spark, place_rows):
    rng = random.Random(8)
    keys = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            keys.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    keys = sorted(keys)
    signed = {k - (1 << 64) if k >> 63 else k: k for k in keys}

    def roots(edges):
        up = {k: k for k in keys}

        def find(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in edges:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
        return {k: find(k) for k in keys}

    want = roots([(a, b) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 3])
    found = [(signed[r["src"]], signed[r["dst"]]) for r in near_edges(spark.createDataFrame([(k,) for k in signed], "fp long"), 3, place_rows).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found) and roots(found) == want


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs = [(r["doc_id"], r["text"]) for r in Q.table(spark, SF, "documents").collect()]
    model = train(Q.table(spark, SF, "documents"), Q.table(spark, SF, "labels"), Q.held_out())
    left = [(i, t) for i, t in docs if model.score(t) >= 0.7]
    left = [(i, t) for i, t in left if not any(r.rejects(TextFacts(t)) for r in base_rules() + default_rules())]
    keep = {}
    for i, t in left:
        keep[t] = max(i, keep.get(t, i))
    left = [(i, t) for i, t in left if keep[t] == i]
    from roadloom.llm.simhash import simhash64

    prints = {i: simhash64(t) for i, t in left}
    low = {i: i for i in prints}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = find(a), find(b)
                low[max(p, q)] = min(p, q)
    want = {i for i in ids if find(i) == i}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == want and len(want) > 10
    enc, texts = P.ByteBpe(P.default_tokenizer_path()), dict(left)
    length = Counter()
    for r in rows:
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(enc.encode(texts[i])) // 4 + 1 for i in want}
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) >= -(-sum(length.values()) // 1024)


def test_sizes_in_sparks_units(spark):
    assert [bytes_of(x) for x in ("64m", "4194304", "64MB", "-1", " 1 g ", "5b", "2kb")] == [64 << 20, 4 << 20, 64 << 20, -1, 1 << 30, 5, 2048]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        bound_batches(spark)
        assert spark.conf.get(key) == str(4 << 20)
        spark.conf.set(key, "1m")
        bound_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_shards_with_fewer_partitions_than_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50, f"text {i % 70}") for i in range(600)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(sharding, "MOST_PARTITIONS", 2)
    out = sharding.shuffled_shards(docs, 7, bucket_bytes=200)
    assert out.rdd.getNumPartitions() <= 2
    rows = out.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} <= {85, 86}


def test_lines_of_rows_without_id_are_dropped_by_row(spark):
    """A third of the rows have no doc_id; each loses its own lines only."""
    common = "a line that every document holds"
    rows = [(None if i % 3 == 0 else i, f"{common}\nline of document {i} and of no other\n{common}") for i in range(300)]
    docs = spark.createDataFrame(rows + [(None, "short")] * 50, "doc_id long, text string").repartition(5)
    got = line_dedup(docs)
    assert not [n for n, f in line_dedup(docs.limit(0)).dtypes if n not in got.columns]
    found = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect())
    want = Counter((i, 3, 0 if i == 299 else 2, t if i == 299 else t.split("\n")[1]) for i, t in rows)
    want[None, 1, 0, "short"] = 50
    assert found == want


@pytest.mark.parametrize("worse", [True, False])
def test_sequences_are_packed_again_only_while_they_become_fewer(spark, monkeypatch, worse):
    """A first round that fills each sequence half; then one that gives every piece its own, or the real one."""
    plain, turns = P._pack_round, []

    def packed(items, n, *more):
        turns.append(n)
        if len(turns) == 1:  # two pieces of 250 a sequence
            return items.select(F.lit(0).alias("block"), F.floor(F.col("uid") / 2).cast("int").alias("bin"), "uid", "length")
        return items.select(F.lit(0).alias("block"), F.col("uid").cast("int").alias("bin"), "uid", "length") if worse else plain(items, n, *more)

    monkeypatch.setattr(P, "_pack_round", packed)
    pieces = spark.createDataFrame([(i, 250) for i in range(40)] + [(100, 1024)], "uid long, length int")
    rows = P.pack(pieces).collect()
    assert sorted(r.uid for r in rows) == [*range(40), 100]
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append(r.offset)
    assert len(held) == (21 if worse else 11)
    assert all(sorted(v) == [250 * i for i in range(len(v))] for v in held.values())
    assert turns[0] == turns[1] == 40 and len(turns) == 2
