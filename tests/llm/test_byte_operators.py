"""Token shards and counts, archives, top-k, toxicity and URL filters on small tables."""

import base64
import gc
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triagemill.llm import tokenbin, tokencount, topk, toxicity, urlgraph, warc

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", None, " a b  c\n\n d\x1c\x1d e", "<|endoftext|> x<|startoftext|>,y. <|ENDOFTEXT|>.", "don't.  I'LL, we'Ve ...,", "Straße ÀÉÎ ßÿŸ, ŒUVRE. ª º µm",
        "e\u0301 É, \u0301x İx Σας ΣΑΣ. ﬁ", "日本語 テスト。😀👍🏽 \u3000x\u0085y", "\u0558 \u088f x", "a\x00b \ufeff", "1234.5, 12,345.", "word, " * 9000, "same.", "same."]


@given(st.lists(st.integers(0, 1 << 40)))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    ef, rest = tokenbin.EliasFano.load(memoryview(tokenbin.EliasFano.of(np.array(values, np.uint64)).dump() + b"rest"))
    assert bytes(rest) == b"rest" and ef.all().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_large():
    values = np.cumsum(np.random.default_rng(1).integers(0, 900, 50_000))
    data = tokenbin.EliasFano.of(values).dump()
    assert len(data) < 2 * len(values)  # a table of 64-bit numbers takes eight bytes each
    ef, _ = tokenbin.EliasFano.load(memoryview(data))
    assert all(ef.select(i) == values[i] for i in range(0, 50_000, 997))
    with pytest.raises(IndexError):
        ef.select(50_000)


def test_token_shards(spark):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = [(None, "no id"), (None, "no id")] + [(i * 7 - 20, t) for i, t in enumerate(HARD)] + [(5, "five"), (5, "fiver")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("extra")).repartition(5)
    path = tokenbin.write_tokens(docs, WORD_BPE, shard_bytes=4000)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.read_tokens(spark, path).collect()), key=str)
    crc = lambda t: (lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))(tok.encode(t or "", add_special_tokens=False).ids + [2])
    assert sorted((x[1:] for x in got), key=str) == sorted(((k, *crc(t)) for k, t in rows), key=str)
    at = 0
    for start, key, n, _ in sorted(got):
        assert start == at
        at += n
    keys = [x[1] for x in sorted(got)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    data = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    found = {s.doc_id(i): s.document(i).tolist() for d in data for s in tokenbin.shards_of(bytes(d)) for i in range(s.n)}
    assert found[22] == tok.encode(HARD[6], add_special_tokens=False).ids + [2]
    assert tokenbin.read_tokens(spark, tokenbin.write_tokens(docs.limit(0), WORD_BPE)).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_equal_the_tokenizer(text):
    words = tokenbin._words.setdefault("test", tokenbin.Words(WORD_BPE))
    assert np.frombuffer(words.encode([text.encode()])[0], words.kind).tolist() == words.tok.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_tokenizer(text):
    counter = tokencount._counters.setdefault("test", tokencount.Counter(BYTE_BPE, tokencount.whole_tokens(BYTE_BPE)))
    assert counter.counts([text]) == [len(counter.tok.encode(text, add_special_tokens=False))]


def test_plain_ranges_agree():
    """Both pattern engines part all code points of the plain ranges alike."""
    import regex

    pre, piece = Tokenizer.from_file(BYTE_BPE).pre_tokenizer, regex.compile(tokencount.PIECE)
    for a, b in tokencount.PLAIN_RANGES:
        for lo in range(a, b + 1, 512):
            x = "".join(f"a{c}1 {c} {c}{c}!" for c in map(chr, range(lo, min(lo + 512, b + 1))) if not 0xD800 <= ord(c) < 0xE000)
            assert [x[p[0]:p[1]] for _, p in pre.pre_tokenize_str(x)] == piece.findall(x)


def test_whole_tokens():
    whole, tok = tokencount.whole_tokens(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    assert len(whole) > 45_000 and "<|endoftext|>" not in whole
    assert all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::97])


def test_count_tokens(spark):
    tok = Tokenizer.from_file(BYTE_BPE)
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("n_tokens", F.lit("extra"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(docs, BYTE_BPE, 10).collect()}
    want = {i: (len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 10) for i, t in enumerate(HARD)}
    assert got == want and tokencount.count_tokens(docs.limit(0), BYTE_BPE).count() == 0


def test_record_ids():
    for key in (None, 0, 1, -1, -7, 2**63 - 1, -(2**63)):
        assert warc.key_of(warc.record_id(key)) == key


def test_arc_lines():
    for version in (1, 2):
        x = warc.parse_arc(warc.arc_record("http://a b/\n", b"pay\r\n\r\nload", 5, version, "20240506070809"))
        assert (x["url"], x["payload"], x["key"], warc.iso_time(x["date"])) == ("http://a%20b/%0A", b"pay\r\n\r\nload", 5, "2024-05-06T07:08:09Z")
    with pytest.raises(ValueError):
        warc.parse_arc(b"http://a 0.0.0.0 20240101000000 text/html 50\nshort\n")
    with pytest.raises(ValueError):
        warc.parse_arc(b"http://a 0.0.0.0 20240101000000\n\n")


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    html = ["same payload", "same payload", None, "", "é\r\n\r\n", "same payload", "ab", "ab"]
    rows = [(i * 3 + 1, f"http://x/{i}" if i else None, h) for i, h in enumerate(html)] + [(None, "u", "same payload"), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("extra")).repartition(3)
    path = warc.write_warc(warc.to_arc(pages), min_bytes=least)
    got = sorted((tuple(r) for r in warc.read_warc(spark, path).collect()), key=str)
    want = []
    for key, _, h in rows:
        data = (h or "").encode()
        first = min(k for k, _, g in rows if (g or "") == (h or "") and k is not None) if len(data) >= least and any(
            (g or "") == (h or "") and k is not None for k, _, g in rows) else key
        seen = first != key
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((key, len(data), digest, "revisit" if seen else "response", first if seen else None))
    assert got == sorted(want, key=str)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    records = [x for f in files for x in warc.parse_warc(f)]
    assert len(records) == len(rows) and all(x["WARC-Type"] in ("response", "revisit") for x in records)
    empty = warc.write_warc(warc.to_arc(pages.limit(0)))
    assert warc.read_warc(spark, empty).count() == 0


def test_top_k(spark):
    rng = random.Random(4)
    vectors = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(300)]
    rows = list(enumerate(vectors)) + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf"), 1.0]), (1004, []), (1005, [0.5]),
                                       (1006, [0.0] * 6), (None, [1.0] * 6), (7, vectors[7]), (400, vectors[8])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("extra"))
    got = {}
    for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5, rows_per_block=64, queries_per_block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    sound = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, a in sound:
        if q is not None and q % 50 == 0:
            all_ = sorted(((-sum(x * y for x, y in zip(a, b)), i is None, i) for i, b in sound if i != q), key=lambda x: (x[0], x[1], x[2] or 0))[:5]
            want[q] = [(n + 1, i, -s) for n, (s, _, i) in enumerate(all_)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.top_k(frame.limit(0), F.lit(True), 5).count() == 0


def test_top_k_of_repeated_queries(spark):
    rng = random.Random(14)
    vectors = [[float(rng.randrange(-9, 10)) for _ in range(4)] for _ in range(120)]
    rows = list(enumerate(vectors)) + [(50, vectors[50])] * 2 + [(100, vectors[3]), (100, vectors[3]), (7, vectors[7])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, 5, scale=1, rows_per_block=32, queries_per_block=2).collect()
    want = []
    for q, a in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:  # 0, 50 and two vectors of 100
        best = sorted((-int(sum(x * y for x, y in zip(a, b))), i) for i, b in rows if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 20


def test_top_k_stops_early():
    rows = np.zeros((4096, 3))
    rows[:20, 0] = np.arange(100, 120)
    lists = topk.SortedLists(np.array(range(4096), object), rows)
    assert lists.search(np.array([2.0, 0, 0]), None, 3) == [(238, 19), (236, 18), (234, 17)]
    big = topk._matrix([[1 << 40, -(1 << 41)], [3, 4]], 2)
    assert big.dtype == object and topk.SortedLists(np.array([1, 2], object), big).search(big[0], 1, 1) == [(3 * (1 << 40) - 4 * (1 << 41), 2)]


def test_toxicity(spark):
    rng = random.Random(6)
    clean = ["river", "stone", "walking", "paper", "green", "window", "garden", "morning"]
    bad = ["vilecreature", "rottenfool"]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(clean) + rng.choice(("", "s", "ly", "ing")) for _ in range(rng.choice((6, 40, 150)))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("extra"))
    marks = spark.createDataFrame(labels + [(0, 0), (9999, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, marks, 200)
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 5 != 0 and i % 4 == 0 for i in range(500)) + 200
    model = toxicity.fit(sample)
    test = [(10_000, "green rivers, vilecreatures"), (10_001, "rotenfool"), (10_002, ""), (10_003, None), (10_004, "stone " * 5000 + "rottenfool"),
            (10_005, "river stone walking"), (10_006, "stone " * 5000)]
    scored = toxicity.score_texts(docs.unionByName(spark.createDataFrame(test, "doc_id long, text string").withColumn("score", F.lit("x"))), model)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    assert [got[i] >= 0.5 for i, _ in test] == [True, True, False, False, True, False, False]
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in range(500) if got[i] < 0.5}
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def plain_score(model, text, window=8):
    """Windows, repetitions and averages by plain loops, over the fitted vectors."""
    words = re.findall(r"\w*[^\W\d_]\w*", (text or "").lower())
    value = {}
    for w in set(words):
        parts = [f"<{w}>"] + [f"<{w}>"[i:i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
        value[w] = sum(float(model.values[zlib.crc32(p.encode()) % len(model.values)]) for p in parts) / len(parts)
    counted = [model.usual if w in words[max(0, i - window + 1):i] else value[w] for i, w in enumerate(words)]
    if not counted:
        worst = model.blank
    elif len(counted) <= window:
        worst = sum(counted) / len(counted)
    else:
        worst = max(sum(counted[i:i + window]) / window for i in range(len(counted) - window + 1))
    return 1 / (1 + math.exp(-max(-40, min(40, model.slope * (worst + model.bias) + model.shift))))


def test_toxicity_equals_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = toxicity.fit(toxicity.training_sample(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")))
    more = [(9001, None), (9002, ""), (9003, "1 2 3"), (9004, "word"), (9005, "a b a b a b c a b a b"), (None, "ID less"), (9006, "é ß " * 30_000)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model).collect()}
    assert got == {r["doc_id"]: pytest.approx(plain_score(model, r["text"]), abs=1e-4) for r in docs.collect()}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in held}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 0)]):
        model = toxicity.fit(toxicity.training_sample(docs, spark.createDataFrame(rows, "doc_id long, toxic int")))
        assert all(r["score"] < 0.5 for r in toxicity.score_texts(docs, model).collect())


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")],
                                  "host string, path string, verdict string")
    urls = ["http://a.com/x", "https://WWW.Example.COM/en/1?q#f", "https://m.example.com/en/", "https://example.com/fr", "http://com", "http://com/",
            "http://xcom/", "ftp://q.net/es/a?b", "http://q.net/es", "//no.scheme.com/x", None, "", "http://", "x://u:p@h.net:80/es/", "http://a.com?x=://b.net/es/",
            "http://a.com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlgraph.judge_urls(pages, rules).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("com/", "allow") and got[4] == ("com", "", None, "allow")
    assert got[5][2] == "com/" and got[6][2] is None and got[7] == ("q.net", "/es/a", "net/es/", "block") and got[8][2] is None
    assert got[9] == got[10] == got[11] == ("", "", None, "allow") and got[12][:2] == ("", "") and got[13][:3] == ("u:p@h.net:80", "/es/", None)
    assert got[14] == ("a.com", "", None, "allow") and got[15] == got[0] and len(got) == len(urls)
    assert urlgraph.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlgraph.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_link_graph(spark):
    """Distrust goes to those who link to blocked hosts, trust to those whom trusted hosts link to."""
    rules = spark.createDataFrame([("bad.org", "/", "block"), ("good.org", "/", "allow")], "host string, path string, verdict string")
    a = lambda *hosts: "".join(f'<a HREF="https://{h}/p">x</a>' for h in hosts)
    html = {"bad.org": "", "good.org": a("both.net", "friend.net"), "farm.net": a("bad.org", "Bad.org", "farm.net"), "both.net": a("bad.org"),
            "far.net": a("farm.net"), "friend.net": a("else.net"), "lone.net": None}
    pages = spark.createDataFrame([(i, f"http://{h}/", x) for i, (h, x) in enumerate(html.items())], "page_id long, url string, html string")
    rows = {r["host"]: r for r in urlgraph.judge_urls(pages, rules, threshold=0.2).collect()}
    edges = {("good.org", "both.net"), ("good.org", "friend.net"), ("farm.net", "bad.org"), ("both.net", "bad.org"), ("far.net", "farm.net"), ("friend.net", "else.net")}

    def rank(links, seed):
        score = {seed: 1.0}
        for _ in range(urlgraph.ROUNDS):
            new = {seed: 1.0}
            for x, y in links:
                new[y] = new.get(y, 0) + 0.85 * score.get(x, 0) / sum(u == x for u, _ in links)
            score = new
        return score

    trust, distrust = rank(edges, "good.org"), rank({(y, x) for x, y in edges}, "bad.org")
    for h, r in rows.items():
        assert (r["trust"] or 0, r["distrust"] or 0) == (pytest.approx(trust.get(h, 0)), pytest.approx(distrust.get(h, 0)))
        gap = distrust.get(h, 0) - trust.get(h, 0)
        assert r["verdict"] == ("block" if gap > 0.2 else "allow")
    assert [rows[h]["verdict"] for h in ("farm.net", "far.net", "both.net", "lone.net")] == ["block", "block", "allow", "allow"]


def test_toxicity_sample_has_one_text_of_an_id(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(ids[0], f"copy {i}") for i in range(500)] + [(i, f"text {i}") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs.repartition(4), labels)
    assert len(sample) == len(ids) and sum(t.startswith("copy") for t, _ in sample) == 1


def test_link_graph_with_a_long_chain_and_a_loop(spark):
    """Against the exact solution of score = seed + damping * (share of the scores that link here)."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(16)]
    loop = [(f"l{i}", f"l{(i + 1) % 13}") for i in range(13)] + [("l3", "l0"), ("l3", "c2")]
    links = chain + loop
    hosts = sorted({h for x in links for h in x})
    at = {h: i for i, h in enumerate(hosts)}
    seeds = {"c0": (1.0, 0.0), "l0": (1.0, 0.25), "c16": (0.0, 1.0)}
    want = []
    for side in (0, 1):
        pairs = [x[::-1] if side else x for x in links]
        matrix = np.zeros((len(hosts), len(hosts)))
        for x, y in pairs:
            matrix[at[y], at[x]] = 0.6 / sum(u == x for u, _ in pairs)
        want.append(np.linalg.solve(np.eye(len(hosts)) - matrix, [seeds.get(h, (0.0, 0.0))[side] for h in hosts]))
    frame = spark.createDataFrame([(h, *w) for h, w in seeds.items()], "host string, trust double, distrust double")
    rows = {r["host"]: r for r in urlgraph.spread(spark.createDataFrame(links, "src string, dst string"), frame, damping=0.6).collect()}
    assert [rows[h]["trust"] for h in hosts] == pytest.approx(want[0], abs=2e-6)
    assert [rows[h]["distrust"] for h in hosts] == pytest.approx(want[1], abs=2e-6)


def test_words_make_no_collections():
    """Encoding a batch starts no search for cycles (one may follow it), and leaves the setting as it was."""
    words, runs = tokenbin.Words(public_tokenizers.path("word_bpe_49k.json")), []
    texts = [" ".join(f"Stem{chr(97 + i % 26)}{chr(97 + j % 26)}{'x' * (j % 7)}, {i}" for j in range(200)).encode() for i in range(300)]
    count = lambda phase, info: runs.append(phase)
    gc.callbacks.append(count)
    try:
        got = words.encode(texts)
        seen = len(runs)
    finally:
        gc.callbacks.remove(count)
    assert seen <= 2 and gc.isenabled()  # a search calls twice
    want = [np.array(words.tok.encode(t.decode(), add_special_tokens=False).ids, words.kind).tobytes() for t in texts]
    assert got == want
