"""Secret scans, ranked search and spelling variants on small tables, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagemill.llm import ranked, secrets, spelling

EXTRA = "lang string, n_chars long, _id string, _key string, spans string, word string, n long, rank int, score long"


def docs_of(spark, rows, parts=3):
    """Documents (doc_id, text, source) with extra columns whose names clash with those the operators make."""
    full = [(i, t, s, None, None, "x", "y", "z", "w", 1, 2, 3) for i, t, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, source string, {EXTRA}").repartition(parts)


# ---- secrets


def brute_spans(text):
    found = []
    for kind, pattern, least in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
                                 ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16), ("run", "[A-Za-z0-9+/_=-]+", 20)):
        for m in re.finditer(pattern, text or "", re.I | re.A if kind == "assign" else 0):
            value = m.group(2) if kind == "assign" else m.group()
            if len(value) >= least:
                found.append((m.start(), kind, m.end(), value))
    return found


def brute_scan(rows):
    owners, repos = defaultdict(set), defaultdict(set)
    for i, t, s in rows:
        for _, _, _, v in brute_spans(t):
            owners[v].add(s)
            repos[v].add((s, i))
    out = []
    for i, t, _ in rows:
        spans = set()
        for start, kind, end, v in brute_spans(t):
            copied = len(owners[v]) >= 3 or len(repos[v]) >= 20
            live = len(v) >= 16 and re.search("[A-Za-z]", v) and re.search("[0-9]", v) and len(set(v)) >= 8
            verdict = "copied" if copied else "owned" if live and len(owners[v]) == 1 else "unclear"
            if kind != "run":
                spans.add((start, secrets.KINDS.index(kind), end, verdict))
            if verdict == "owned":
                spans.add((end - len(v), 3, end, verdict))
        out.append((i, tuple(sorted(spans))))
    return sorted(out, key=repr)


def got_scan(df):
    return sorted(((r["doc_id"], tuple((s["start"], s["rank"], s["end"], s["verdict"]) for s in r["spans"])) for r in df.collect()), key=repr)


def test_secrets(spark):
    rng = random.Random(11)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes = [some("0123456789abcdef", 40) for _ in range(6)]
    keys = ["AKIA" + some("ABCDEFGHIJKLMNOP0123", 16) for _ in range(4)]
    texts = [None, "", "é" * 5 + f'Token = "{hexes[0]}" ü', f"x{hexes[0]}", f"password: token = {hexes[1]}", "api_key=short", "APIKEY:'abcdefghijkl",
             "paſſword = abcdefghijklm", f"{keys[0]}{keys[1]} AKIA123 {keys[2]}", "4417744280351547", "a" * 40, some("abcdef0123", 15),
             f"passwd =   {some('abc.XYZ019_=', 20)} secret:{hexes[2]}", "token:abc token==aaaaaaaaaaaaaaaa", "\U0001f600 " + f"secret={hexes[3]}" * 3,
             some("abcXYZ019+/", 30) + " " + some("abcXYZ019+/", 19)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, f"copy token={hexes[4]}", f"s{i % 5}") for i in range(40)]  # widely copied
    rows += [(200 + i, f"own token={hexes[5]}", "s0") for i in range(19)]  # one owner, few repositories
    rows += [(300 + i, f"own {keys[3]}", "s1") for i in range(20)]  # one owner, many repositories
    rows += [(None, f"token={hexes[2]}", None), (None, f"token={hexes[1]}", None), (2, "another text", "s9"), rows[2], rows[2], rows[3]]
    many = " ".join(f"token{i}={some('0123456789abcdef', 32)}" for i in range(700))  # several blocks of places
    rows.append((400, many, "s2"))
    assert got_scan(secrets.scan_secrets(docs_of(spark, rows))) == brute_scan(rows)
    assert secrets.scan_secrets(docs_of(spark, [])).count() == 0


def test_no_place_of_a_long_text_is_lost(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["é ", "word ", "token = 'abcdefghijkl0123' ", "deadbeefdeadbeef0 "]) for _ in range(60_000))
    got = got_scan(secrets.scan_secrets(docs_of(spark, [(1, text, None)])))
    assert got == brute_scan([(1, text, None)])


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_rank(rows, items, k):
    bags = [(i, Counter(TERM.findall(low(t)))) for i, t in rows]
    bags = [(i, c) for i, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(w for _, c in bags for w in c)
    out = []
    for item, text in set(items):
        q = Counter(TERM.findall(low(text)))
        scored = []
        for i, c in bags:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, x in q.items() if w in c)
            if s > 0:
                scored.append((-s, i is not None, i))
        out += [(item, rank, x[2], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 1024, "STEP": 8}, {"CELLS": 500}, {"BLOCK_ITEMS": 7, "BLOCK_BYTES": 300}])
def test_ranked(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(60)] + ["É", "x7", "ß"]
    make = lambda n: " ".join(vocab[min(int(rng.expovariate(0.08)), len(vocab) - 1)] for _ in range(n))
    rows = [(i, make(rng.choice((1, 5, 40, 200)))) for i in range(1500)]
    rows += [(5000 + i, rows[3][1]) for i in range(200)]  # ties
    rows += [(7, make(20)), (7, rows[7][1]), (None, make(30)), (None, make(30)), (9000, None), (9001, ""), (9002, "... !"), (9003, make(20_000).upper())]
    items = [(i, make(rng.choice((1, 3, 30)))) for i in range(20)] + [(20, rows[3][1]), (21, None), (22, "?"), (23, "unknown"), (20, "w1 w1 w2"), (None, "w5 w6"),
                                                                    (0, "É x7"), (24, make(900))]
    items.append(items[2])
    docs = docs_of(spark, [(i, t, "s") for i, t in rows], 4)
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, doc_id int")
    got = ranked.rank_documents(docs, bench, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    # of one id with equal scores either row may come first: ids and scores are equal
    many = {x for x in items if sum(y[0] == x[0] for y in set(items)) > 1}
    want = brute_rank(rows, items, 7)
    assert sorted(map(tuple, got.collect()), key=repr) == want and many


def test_ranked_empty(spark):
    docs, bench = docs_of(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.rank_documents(docs, bench).count() == 0
    assert ranked.rank_documents(docs_of(spark, [(1, "a", "s")]), bench.filter("false")).count() == 0


def test_intervals_are_left_out():
    """With a clear winner most documents are never scored."""
    rng = np.random.default_rng(0)
    n = 20_000
    tfs = np.ones(n + 10, np.int64)
    ids = np.concatenate((np.zeros(n, np.int64), np.ones(10, np.int64)))
    of = np.concatenate((np.arange(n), rng.choice(n, 10, replace=False)))
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=n)
    shard = ranked.Shard(list(range(n)), rng.integers(20, 400, n), counts, ids[order], tfs[order], n, 200 * n)
    met = []
    shard.impact = _Watched(shard.impact, met)
    score, place = shard.search(np.array([0, 1]), np.array([10, 7000]), 10, (np.zeros(0, np.int64), np.zeros(0)))
    assert set(place) == set(of[n:]) and sum(met) < 40 * 1000


class _Watched:
    def __init__(self, data, met):
        self.data, self.met = data, met

    def __getitem__(self, i):
        self.met.append(np.size(i))
        return self.data[i]


# ---- spelling


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 2 * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, n[a], len(near[a]), form[a], n[form[a]] if form[a] else None, root))
    return sorted(out)


def test_spelling(spark):
    rng = random.Random(13)
    letters = "abcdeéÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice((5, 6, 7, 9)))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaaaa"]
    words = []
    for w in base:
        for _ in range(12):
            i, v = rng.randrange(len(w)), w
            v = rng.choice((v[:i] + v[i + 1:], v[:i] + rng.choice(letters) + v[i:], v[:i] + rng.choice(letters) + v[i + 1:], v))
            words += [v.upper() if rng.random() < 0.2 else v] * int(2 ** rng.uniform(0, 6))
    rng.shuffle(words)
    rows = [(i, rng.choice((" ", "7", "-", "\n")).join(words[i * 9:i * 9 + 9])) for i in range(len(words) // 9)]
    rows += [(None, "aaaaab aaaaab aaaaab"), (4, None), (5, ""), (6, "1234 ..."), rows[0], rows[0], (8, "x" * 100_000 + " Œaaaaa×÷À")]
    got = spelling.group_variants(docs_of(spark, [(i, t, "s") for i, t in rows]))
    assert sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == brute_variants(rows)
    assert spelling.group_variants(docs_of(spark, [])).count() == 0


def test_every_edit_shares_a_signature(spark):
    rng = random.Random(7)
    words = set()
    for _ in range(150):
        w = "".join(rng.choice("aabcdeé") for _ in range(rng.randrange(5, 12)))
        i = rng.randrange(len(w))
        words |= {w, w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "q" + w[i + 1:], w[::-1]}
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(rows).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert spelling.signatures(rows).filter(F.col("sig").isNull()).isEmpty()
