"""Each operator against a plain version on a small fixture with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadloom.llm import exact_dedup as ED
from roadloom.llm import queries as Q
from roadloom.llm.line_dedup import line_dedup
from roadloom.llm.packing import best_fit_packing, default_tokenizer_path, pieces_of
from roadloom.llm.quality_classifier import features, quality_scores
from roadloom.llm.quality_rules import default_rules, drop_rejected, first_rejection, order_rules, quality_rules, with_stats
from roadloom.llm.sentencepiece_fst import Transducer, decode_documents, default_model_path, encode_documents
from roadloom.llm.sharding import shuffled_shards, write_shards
from roadloom.llm.simhash import drop_near_copies, near_dedup, simhash64, trie_self_join
from roadloom.llm.tool_calls import link_tool_calls
from roadloom.llm.url_filter import UrlRule, rule_labelled, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, keep_id string, fingerprint int"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "gamma,", "delta.", "ÉTÉ", "zeta", "eta", "theta", "日本", "mu"]
    return " ".join(f"{words[i % 10]}{i}" for i in rng.integers(0, 4000, n))


def fixture_rows():
    base = prose(1, 120)
    near = prose(2, 900)
    rows = [
        (1, base), (2, base), (3, base + " x"), (4, None), (5, ""), (6, " \t\n "), (7, near), (8, near.replace("alpha", "alpha!", 1)),
        (9, "One line that is long enough to count here\nshort\nanother"), (10, "  one LINE that is long enough to count here \nother"),
        (11, "one line that is long enough to count here\r"), (12, prose(3, 30000)), (13, "a b"), (14, "# " * 80), (15, "WORD " * 90), (None, "null id text"),
        (16, "x" * 9000), (16, "x" * 9000),
    ]
    return [(i, t, "en", "clash", 7) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(i, t or "") for i, t, *_ in fixture_rows()]


def test_exact_dedup_matches_brute_force(docs, empty):
    groups = defaultdict(list)
    for i, t in texts():
        groups[t].append(i)
    expected = Counter()
    for i, t in texts():
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        expected[(i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in ED.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == expected
    assert ED.exact_dedup(empty).count() == 0
    assert set(ED.drop_copies(docs).columns) == set(docs.columns)


def test_stages_drop_rows_and_not_ids(spark):
    copy, other, lone = prose(1, 120), prose(2, 130), prose(4, 140)
    near = prose(5, 900)
    rows = [(1, copy), (2, copy), (None, copy), (None, lone), (1, other)]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "clash", 7) for i, t in rows], SCHEMA).repartition(3)
    held = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert held(ED.drop_copies(frame(rows))) == Counter([(2, copy), (None, lone), (1, other)])
    rows = [(1, near), (None, near), (5, near + " tail"), (None, lone), (5, other)]
    assert (simhash64(near) ^ simhash64(near + " tail")).bit_count() <= 3
    assert held(drop_near_copies(frame(rows))) == Counter([(1, near), (None, lone), (5, other)])


def test_chunks_cover_the_text_and_colliding_hashes_are_told_apart(docs):
    rows = docs.select(F.coalesce("text", F.lit("")).alias("t"), ED.chunks_of(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] and all(len(x) <= ED.MAX_CHARS for x in r["c"]) for r in rows)
    weak = ED.exact_dedup(docs, lambda c: F.length(c).cast("long") % 3)
    assert Counter(map(tuple, weak.collect())) == Counter(map(tuple, ED.exact_dedup(docs).collect()))


def brute_components(prints, budget=3):
    ids = sorted(prints)
    low = {f: f for f in ids}

    def find(f):
        while low[f] != f:
            f = low[f]
        return f

    for a in ids:
        for b in ids:
            if a < b and (a ^ b).bit_count() <= budget:
                low[find(b)] = find(a)
    return {f: find(f) for f in ids}


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("place_rows", [20_000, 2])
def test_near_dedup_matches_brute_force(docs, empty, place_rows):
    prints = {t: plain_simhash(t) for _, t in texts()}
    assert all(simhash64(t) == f for t, f in prints.items())
    root = brute_components(set(prints.values()))
    low = {}
    for i, t in texts():
        r = root[prints[t]]
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    expected = Counter((i, f"{prints[t]:016x}", low[root[prints[t]]]) for i, t in texts())
    got = Counter(tuple(r) for r in near_dedup(docs, place_rows=place_rows).select("doc_id", "fingerprint", "component_id").collect())
    assert got == expected
    assert near_dedup(empty).count() == 0


def test_trie_join_matches_brute_force():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 150, dtype=np.uint64)
    for k in range(150):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            keys = np.append(keys, keys[k] ^ np.uint64(1 << int(b)))
    keys = np.unique(keys)
    want = brute_components([int(k) for k in keys])
    low = list(range(len(keys)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in trie_self_join(keys, np.array([0, len(keys)]), 3, frontier=50):
        assert (int(keys[i]) ^ int(keys[j])).bit_count() <= 3
        a, b = find(i), find(j)
        low[max(a, b)] = min(a, b)
    assert {int(keys[i]): int(keys[find(i)]) for i in range(len(keys))} == want


def test_quality_rules_do_not_depend_on_their_order(docs, empty):
    rows = {(r["doc_id"], r["n_words"], r["n_repeat_words"]): r for r in quality_rules(docs).collect()}
    by_id = {k[0]: r for k, r in rows.items()}
    assert by_id[4]["n_words"] == 0 and by_id[4]["base_failed"] and not by_id[4]["kept"]
    assert by_id[1]["kept"] and by_id[12]["kept"] and not by_id[14]["kept"] and not by_id[15]["kept"]
    assert by_id[15]["n_repeat_words"] == 90 and by_id[14]["n_symbols"] == 80
    stats = with_stats(docs)
    a, b = first_rejection(default_rules()).isNull(), first_rejection(default_rules()[::-1]).isNull()
    assert stats.where(a != b).count() == 0
    assert {r.name for r in order_rules(docs, default_rules())} == {r.name for r in default_rules()}
    assert quality_rules(empty).count() == 0
    assert sorted(r["doc_id"] for r in drop_rejected(docs).select("doc_id").collect()) == sorted(i for i, r in by_id.items() if r["kept"])


def test_packing_tiles_every_document(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer_path())
    rows = best_fit_packing(docs, block_items=4).collect()
    by_seq, total = defaultdict(list), 0
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        total += r["length"]
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    ids = {i: whole.encode(t, add_special_tokens=False).ids + [2] for i, t in texts()}
    assert total == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts())
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    assert len(by_seq) <= -(-total // 1024) + 2
    assert best_fit_packing(empty).count() == 0


def test_tokens_of_awkward_texts_match_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer_path())
    awkward = ["a  b   c", "it's I'll 'quoted' a.b,c;d:e!? f", " lead", "trail ", "x\n y\n\nz", "<|endoftext|> in text", "naïve ÉÉ 日本語 🎉🎉 ½ 12.5%", "\u00a0nb sp", "a\u3000b c"]
    df = spark.createDataFrame(list(enumerate(awkward)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in pieces_of(df, default_tokenizer_path(), keep_ids=True).collect()}
    assert got == {i: whole.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(awkward)}


def test_shards_are_even_whole_and_shuffled(spark, docs, empty, tmp_path):
    rows = shuffled_shards(docs, shards=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, *_ in fixture_rows())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    order = [r["doc_id"] for r in shuffled_shards(many, shards=1).orderBy("slot").collect()]
    assert sorted(order) == list(range(2000)) and abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1
    write_shards(docs, f"{tmp_path}/s", shards=3)
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(rows)
    assert shuffled_shards(empty).count() == 0


def test_line_dedup_matches_brute_force(docs, empty):
    strip = " \t\n\x0b\x0c\r"
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(strip))
    where = defaultdict(set)
    for i, t in texts():
        for line in t.split("\n"):
            if len(low(line)) >= 20:
                where[low(line)].add(i)
    expected = Counter()
    for i, t in texts():
        lines = t.split("\n")
        kept = [x for x in lines if not (len(where.get(low(x), ())) >= 3 and i != max(y for y in where[low(x)] if y is not None))]
        expected[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup(docs).collect()) == expected
    assert sum(k[2] for k in expected) == 2
    assert line_dedup(empty).count() == 0


def test_classifier_on_held_out_labels(spark, docs, empty):
    rows = Q.op10_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = Q.table(spark, "/root/testdata/sf0.01", "labels")
    hit = rows.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert hit[1] > 50 and hit[0] > 0.97
    few = spark.createDataFrame([(1, 1), (7, 1), (14, 0)], "doc_id long, quality int")
    scored = quality_scores(docs, few, Q.held_out()).collect()
    assert len(scored) == len(fixture_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_scores(empty, few, Q.held_out()).count() == 0
    assert quality_scores(docs, few.limit(0), Q.held_out()).count() == len(fixture_rows())


def test_word_variety_covers_the_whole_text():
    fresh = [f"w{i}" for i in range(1000)]
    variety = lambda words: float(features(" ".join(words))[515])
    assert variety(fresh) == 1 and variety(fresh[:7] * 2) == 0.5
    assert variety(fresh + ["junk"] * 1500) == pytest.approx(1002 / 2500)
    assert variety(fresh + [f"v{i}" for i in range(1500)]) == 1 and variety(fresh + ["tail"]) == 1
    half = fresh[:500] * 2
    assert variety(half * 3) == variety(half)


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/5?x#y", "https://example.com/en/70", "http://x.net/de/8", "http://m.example.net/de/81", "http://notnet/de/8", "ftp://org?q", "http://a.org/es/1", "a://b://c/d", "http://a.org/es/1"]
    pages = spark.createDataFrame([(i, u, "en") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labelled = spark.createDataFrame([(f"h{i}.com" if i % 2 else f"k{i}.net", f"/{'en' if i % 2 else 'de'}/{i}", i % 2) for i in range(80)], "host string, path string, blocked int")
    got = {r["page_id"]: r for r in url_filter(pages, Q.URL_RULES, labelled).collect()}
    assert len(got) == len(urls) and all(r["verdict"] in ("allow", "block") for r in got.values())
    assert [got[i]["rule"] for i in (3, 4, 5, 6, 7, 9)] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", None, "org/es/"]
    assert [got[i]["verdict"] for i in (3, 4, 5, 6, 9)] == ["block", "allow", "allow", "block", "block"]
    assert (got[3]["host"], got[3]["path"]) == ("a.example.com", "/en/5") and (got[8]["host"], got[8]["path"]) == ("org", "") and got[0]["host"] == got[2]["path"] == ""
    assert (got[10]["host"], got[10]["path"]) == ("b:", "//c/d")
    none = url_filter(pages, [UrlRule("block", "zz", "/")], rule_labelled(pages, [UrlRule("block", "zz", "/")])).collect()
    assert all(r["verdict"] == "allow" for r in none)
    assert url_filter(pages.limit(0), Q.URL_RULES, labelled).count() == 0


def test_url_model_on_held_out_rows(spark):
    pages = Q.table(spark, "/root/testdata/sf0.1", "pages")
    known = rule_labelled(pages, Q.URL_RULES).distinct()
    out = F.crc32(F.concat("host", "path").cast("binary")) % 4 == 2
    test = known.where(out).select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "host", "path").alias("url"), "blocked")
    test = spark.createDataFrame(test.collect(), test.schema)
    got = url_filter(test, [], known.where(~out)).join(test.select("page_id", "blocked"), "page_id")
    right, n = got.agg(F.avg(((F.col("verdict") == "block") == (F.col("blocked") == 1)).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.9


def test_fst_matches_the_library_and_round_trips(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    got = encode_documents(docs).collect()
    by_text = dict(texts())
    for r in got:
        assert r["ids"] == sp.encode(by_text[r["doc_id"]]) and r["decoded_equal"] and r["n_ids"] == len(r["ids"])
    back = {r["doc_id"]: r["text"] for r in decode_documents(encode_documents(docs)).collect()}
    assert back == by_text
    fst = Transducer(default_model_path(), memo=10)
    for t in ["  two  spaces ", "🎉 é ﬁ \x00", "▁mark", "a" * 300, "tab\tnl\n", "xqzj" * 50]:
        assert fst.encode(t) == sp.encode(t) and fst.decode(fst.encode(t)) == sp.decode(sp.encode(t))
    assert encode_documents(empty).count() == 0


def test_tool_calls(spark):
    calls = [
        ("c", "a", "search", '{"limit": 3, "query": "é"}', []), ("c", "b", "search", '{"query": 5}', ["a"]), ("c", "d", "fetch", "{oops", ["a", "b"]), ("c", "e", "nope", "{}", ["d", "gone"]),
        ("c", "x", "search", None, ["y"]), ("c", "y", "search", "[]", ["x"]), ("c", "z", "count", '{"query":"q","mode":1}', ["x", "a"]), ("c", None, "search", "{}", None), ("c", "a", "search", '{"limit": 9, "query": "z"}', []),
    ]
    results = [("a", "one"), ("a", "two"), ("b", None), ("orphan", "r"), (None, "n")]
    cdf = spark.createDataFrame(calls, "conv_id string, call_id string, name string, arguments string, depends_on array<string>")
    rdf = spark.createDataFrame(results, "call_id string, content string")
    rows = link_tool_calls(cdf, rdf, Q.TOOL_SCHEMAS).collect()
    by = {r["call_id"]: r for r in rows if r["call_id"]}
    assert {k: r["level"] for k, r in by.items()} == {"a": 0, "b": 1, "d": 2, "e": 3, "x": None, "y": None, "z": None, "orphan": None}
    assert by["a"]["n_calls"] == 2 and by["a"]["n_results"] == 2 and by["a"]["valid"] and by["a"]["json"] == '{"arguments":{"limit":3,"query":"é"},"id":"a","name":"search","result":"one"}'
    assert [by[k]["status"] for k in ("a", "b", "d", "orphan")] == ["linked", "linked", "pending", "orphan"]
    assert by["b"]["errors"] == "missing limit; query is not string" and by["d"]["errors"] == "no JSON" and by["e"]["errors"] == "unknown tool" and by["e"]["missing_deps"] == 1
    assert sorted(r["n_calls"] for r in rows if r["status"] == "no_id") == [0, 1]
    chain = spark.range(300).select(F.lit("c").alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.lit("search").alias("name"), F.lit("{}").alias("arguments"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("depends_on"))
    assert all(r["level"] == int(r["call_id"]) for r in link_tool_calls(chain, rdf.limit(0), Q.TOOL_SCHEMAS).collect())
    assert link_tool_calls(cdf.limit(0), rdf.limit(0), Q.TOOL_SCHEMAS).count() == 0
    ring = [("c", "i", "x", "{}", ["a", "b", "d", "o"]), ("c", "a", "x", "{}", ["b"]), ("c", "b", "x", "{}", ["d"]), ("c", "d", "x", "{}", ["a"]), ("c", "o", "x", "{}", []), ("c", "p", "x", "{}", ["o"]), ("c", "q", "x", "{}", ["o", "p"])]
    got = {r["call_id"]: r["level"] for r in link_tool_calls(spark.createDataFrame(ring, cdf.schema), rdf.limit(0), Q.TOOL_SCHEMAS).collect()}
    assert got == {"i": None, "a": None, "b": None, "d": None, "o": 0, "p": 1, "q": 2}


def test_every_turn_of_a_conversation_goes_through_op3_whole(spark, tmp_path):
    turns = [(1, 0, "system", "Be short. Be kind."), (1, 1, "user", "Hi, you. Go on."), (1, 2, "assistant", "First, this. Then \"that\", é."), (1, 3, "user", "Thanks. More?"), (2, 0, "user", "Only. One."), (3, 0, None, "No. Role."), (4, 1, "assistant", None)]
    turns += [(5, t, "assistant", f"Part one, {t}. Part two, {t}.") for t in range(1, 80, 2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = Q.op3_tool_calls(spark, str(tmp_path)).collect()
    held = Counter()
    for r in rows:
        found = json.loads(r["json"])
        if r["n_calls"]:
            arguments = found["arguments"]
            assert isinstance(arguments, dict) or r["errors"] == "no JSON"
            held[(arguments if isinstance(arguments, dict) else json.loads(arguments + "}"))["query"]] += 1
        if r["n_results"]:
            held[found["result"]] += 1
    assert held == Counter(t or "" for *_, t in turns)
    assert {"no JSON"} < {r["errors"] for r in rows}
    assert {r["call_id"]: r["status"] for r in rows if not r["n_calls"]} == {"system_1_0": "orphan", "user_1_1": "orphan", "user_2_0": "orphan", "turn_3_0": "orphan"}


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = Q.table(spark, SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert 0 < out.count() <= before
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert out.count() > 0
