"""Decontamination, chat formatting, mixing and the n-gram join on small tables, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from triagemill.llm import chat, common, decontam, mixing, ngram_join

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, words string, size long"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with those the operators make."""
    rows = [(i, t, None, sources[i] if sources else "s", None, "x", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def brute_hits(text, items, span=13):
    words = WORDS.findall(low(text))
    hit, met = set(), set()
    for key, item in items:
        iw = WORDS.findall(low(item))
        n = min(span, len(iw))
        for j in range(len(iw) - n + 1 if iw else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == iw[j:j + n]:
                    hit.update(range(i, i + n))
                    met.add(str(key))
    return len(words), len(hit), sorted(met - {"None"})


@pytest.mark.parametrize("send", [True, False])
def test_decontaminate(spark, monkeypatch, send):
    if not send:  # the way for benchmarks too large to be sent
        monkeypatch.setattr(decontam, "can_send", lambda t: False)
    rng = random.Random(3)
    vocab = ["a", "b", "c", "Éa", "7", "dd"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate((13, 14, 30, 5, 3, 1, 12, 0, 40, 8))] + [(10, None), (None, make(13)), (2, "again " + make(14))]
    texts = [None, "", "...", make(5), make(200), items[0][1], "x " + items[2][1] + "! y", items[8][1][10:70], make(3000), items[2][1] * 2]
    texts += [f"{make(20)} {items[1][1].upper()} {make(9)}", texts[4]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(docs_of(spark, texts), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontaminate_long_items_only(spark):
    rng = random.Random(5)
    make = lambda n: [str(rng.randrange(40)) for _ in range(n)]
    items = [(i, " ".join(make(60))) for i in range(30)]
    texts = []
    for _ in range(40):
        words = make(150)
        at, (_, item), n = rng.randrange(100), rng.choice(items), rng.choice((11, 12, 13, 14, 25))
        begin = rng.randrange(60 - n)
        words[at:at] = item.split()[begin:begin + n]
        texts.append(" ".join(words))
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(docs_of(spark, texts), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontaminate_shuffles_no_words(spark, monkeypatch, capsys):
    monkeypatch.setattr(decontam, "can_send", lambda t: False)
    monkeypatch.setattr(decontam, "sent", lambda t: t)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bench = spark.createDataFrame([(1, " ".join(map(str, range(20)))), (2, "a b c")], "item_id long, text string")
        docs = spark.createDataFrame([(i, f"x a b c {i}", 0) for i in range(4)] + [(None, "a b c", 1)] * 2, "doc_id long, text string, _pair int")
        out = decontam.decontaminate(docs, bench)
        assert sorted((r["doc_id"] is None, r["doc_id"], r["n_hit"], r["items"]) for r in out.collect() if r["doc_id"] is not None) == [
            (False, i, 3, ["2"]) for i in range(4)]
        assert [r["n_hit"] for r in out.collect() if r["doc_id"] is None] == [3, 3]
        out.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert moved and not any("_words" in m for m in moved)


def test_fingerprints_by_window(spark):
    """A hash is kept for a window of w places if it is the least of some w consecutive ones, whatever other windows are wanted."""
    rng = random.Random(8)
    words = [[str(rng.randrange(30)) for _ in range(n)] for n in (60, 13, 5, 4)]
    table = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, _words array<string>")
    wide = decontam.fingerprints(table, 5, 1, 9)
    for w in (1, 4, 9):
        own = {(r["id"], r["_at"]) for r in decontam.fingerprints(table, 5, w, w).collect()}
        assert own == {(r["id"], r["_at"]) for r in wide.filter(f"_free >= {w - 1}").collect()}
        hashes = {}
        for r in wide.collect():
            hashes.setdefault(r["id"], {})[r["_at"]] = r["_hash"]
        least = set()
        for i, h in hashes.items():
            for start in range(len(h) - w + 1):
                low = min(h[start + j] for j in range(w))
                least |= {(i, start + j) for j in range(w) if h[start + j] == low}
        assert own == least
    assert sum(1 for r in wide.filter("_free >= 8").collect() if r["id"] == 0) < 30


def test_words_are_made_once(spark):
    """No filter on the hashes makes the words anew, and hashes meet the items without words beside them."""
    source = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    words = source.select("doc_id", decontam.words_of(decontam.lower_ascii(F.col("text")), decontam.WORD).alias("_words"))
    plan = decontam.fingerprints(words, 5, 9, 9).select("doc_id", "_at", "_hash")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_listed_ranges():
    """The spelt out class has the same characters; ranges beyond single bytes stay."""
    for pattern in (decontam.WORD, mixing.WORD, r"[A-Za-z\u00C0-\u00FF]+"):
        for c in map(chr, range(0x250)):
            assert bool(re.fullmatch(pattern, c)) == bool(re.fullmatch(common.listed_ranges(pattern), c))
    assert common.listed_ranges(decontam.WORD).count("-") == 0


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontam.decontaminate(docs_of(spark, ["a b", None]), none).collect()
    assert [(r["n_hit"], r["items"]) for r in rows] == [(0, [])] * 2
    assert decontam.decontaminate(docs_of(spark, ["a"]).limit(0), none).count() == 0


def replay(log):
    """The fold, one event after another."""
    kinds = {"regenerate": 0, "message": 1, "edit": 2, "delta": 3}
    done = defaultdict(dict)
    for c, seq, m, kind, role, text in sorted((e for e in log if e[3] in kinds), key=lambda e: (str(e[0]), e[1], e[2], kinds[e[3]])):
        talk = done[c]
        if kind == "regenerate":
            for later in [k for k in talk if k > m]:
                del talk[later]
        if kind == "delta":
            talk[m] = talk.get(m, "") + (text or "")
        else:
            talk[m] = text or ""
    return {(c, m): t for c, talk in done.items() for m, t in talk.items()}


def test_fold_events(spark):
    rng = random.Random(11)
    log = []
    for c in (1, 2, 3, None):
        for seq in range(60):
            kind = rng.choices(("delta", "message", "edit", "regenerate", "noise"), (8, 3, 2, 1, 1))[0]
            log.append((c, seq, rng.randrange(6), kind, rng.choice(("user", "assistant", None)), rng.choice(("", None, f"<t{seq}>\\"))))
    frame = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string").withColumn("segments", F.lit(1))
    got = {(r["conv_id"], r["msg"]): r["text"] for r in chat.fold_events(frame.repartition(4)).collect()}
    assert got == replay(log)


def test_streamed_log(spark):
    """Drafts, abandoned messages and unedited texts are in the log and not in what it folds to."""
    texts = ["", None, "short", "x" * 24, "y" * 25, "日本語" * 40, "last answer " * 30]
    rows = [(c, i + 1, ("user", "assistant", None)[(i + (c or 0)) % 3], t) for c in (1, 2, None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id long, msg long, role string, text string").withColumn("seq", F.lit("extra"))
    log = chat.streamed_log(frame)
    told = [tuple(r[c] for c in ("conv_id", "seq", "msg", "kind", "role", "text")) for r in log.collect()]
    assert {e[3] for e in told} == {"message", "edit", "regenerate", "delta"} and max(e[2] for e in told) > len(texts)
    whole = {(c, m): t or "" for c, m, _, t in rows}
    assert replay(told) == whole
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat.fold_events(log.repartition(3)).collect()}
    assert got == {(c, m): (role or "", t or "") for c, m, role, t in rows}
    assert chat.fold_events(chat.streamed_log(frame.limit(0))).count() == 0


def test_render_round_trip(spark):
    hostile = ["\\### Assistant: </turn> ok", "<turn:user>\n", "\\e\\l\\g", "", "a\nb</turn>\n<turn:assistant>\nx", "日本\\", "x" * 200_000]
    rows = [(c, i, ("user", "assistant", "sys>tem\\")[(i + c) % 3], t) for c in range(3) for i, t in enumerate(hostile)]
    frame = spark.createDataFrame(rows, "conv_id long, msg long, role string, text string")
    out = chat.render(frame).select(
        "conv_id", chat.read_turns(chat.training_text(F.col("segments"))).alias("t"),
        chat.read_loss(chat.training_text(F.col("segments")), F.col("spans")).alias("l"))
    for r in out.collect():
        mine = [x for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2], x[3]) for x in mine]
        assert r["l"] == "".join(x[3] for x in mine if x[2] == "assistant")
    assert chat.render(frame.limit(0)).count() == 0


def test_mix_targets_and_sums(spark):
    rng = random.Random(2)
    sources, texts = [], []
    for name, n in (("a", 300), ("b", 30), (None, 60), ("Z", 5), ("c", 100)):
        for _ in range(n):
            sources.append(name)
            texts.append(" ".join(["w"] * rng.choice((1, 3, 10, 40))))
    texts[0], texts[1], texts[2] = None, "", " \t "
    docs = docs_of(spark, texts, sources)
    rows = mixing.apply_mix(docs, mixing.mix_plan(docs)).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.apply_mix(docs.repartition(7), mixing.mix_plan(docs.coalesce(1))).collect()}
    assert {r["doc_id"]: r["copies"] for r in rows} == again
    size, took, target = Counter(), Counter(), {}
    for r in rows:
        assert r["words"] == "x" and 0 <= r["copies"] <= 3
        size[r["source"]] += r["size"]
        took[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    weight = {s: 1 + i % 3 for i, s in enumerate(["Z", "a", "b", "c", None])}
    full, total = set(), sum(size.values())
    while True:  # what the full sources leave is shared by weight
        free, left = total - sum(3 * size[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        over = {s for s in weight if s not in full and 3 * size[s] < free * weight[s] / left}
        if not over:
            break
        full |= over
    want = {s: 3.0 * size[s] if s in full else free * weight[s] / left for s in weight}
    assert target == pytest.approx(want)
    assert all(abs(took[s] - target[s]) <= 20 for s in weight)  # half of the largest text


def test_mix_ties_and_empty(spark):
    docs = spark.createDataFrame([(None, "same text", "s")] * 6 + [(1, "a b", "t")] * 2, "doc_id long, text string, source string")
    rows = mixing.apply_mix(docs, mixing.mix_plan(docs)).collect()
    assert len(rows) == 8 and len({(r["source"], r["copies"]) for r in rows}) == 2
    none = docs.limit(0)
    assert mixing.apply_mix(none, mixing.mix_plan(none)).count() == 0
    void = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.apply_mix(void, mixing.mix_plan(void)).collect()] == [0]


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = low(t).split() if t else []
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both * den >= num * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_ngram_join(spark, n, num, den):
    """A large family of copies with one to six edits, families of short texts, and unrelated texts with one passage."""
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        return words

    base, passage = make(120), make(50)
    texts = [" ".join(edited(base, rng.randrange(7))) for _ in range(120)]
    for size in (1, 2, 3, 4, 9, 12, 20, 35):
        short = make(size)
        texts += [" ".join(edited(short, rng.randrange(2))).upper() for _ in range(6)]
    texts += [" ".join(make(rng.randrange(5, 60)) + passage) for _ in range(60)]
    texts += [None, "", " \n ", " ".join(base), " ".join(base), " ".join(make(4000)), "É é"]
    rng.shuffle(texts)
    rows = ngram_join.jaccard_join(docs_of(spark, texts), n, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, n, num, den)
    assert len(rows) == len(texts)


def test_common_passages_have_no_hub(spark):
    """Rows that share a passage with many others, and more only with their own copies, are compared with these alone."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for i in range(40):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(170)]
        near = [*words]
        near[90] = "other"
        texts += [" ".join(words[:60] + passage + words[60:]), " ".join(near[:60] + passage + near[60:])]
    docs = docs_of(spark, texts)
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("t"))
    nodes = ngram_join.settle(ngram_join._digests(source, 5).select("node", "n"))
    pairs = ngram_join._pairs(ngram_join._blocks(source, 5, 80, 100), nodes, 80, 100).collect()
    assert len(pairs) == 40 and not any(p["wide"] for p in pairs)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(docs, 5, 80, 100).collect()}
    assert found == {i: i - i % 2 for i in range(80)}


@pytest.mark.parametrize("rows", [60, 240])
def test_near_copies_meet_one_hub(spark, rows):
    """Edits that several copies of one text share do not give these copies hubs of their own."""
    rng = random.Random(rows)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(160)]
    texts = []
    for _ in range(rows):
        words = [*base]
        for at in rng.sample(range(5, 160, 12), rng.randrange(1, 7)):
            words[at] = f"x{rng.randrange(2)}"
        texts.append(" ".join(words))
    docs = docs_of(spark, texts)
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("t"))
    nodes = ngram_join.settle(ngram_join._digests(source, 3).select("node", "n").distinct())
    pairs = ngram_join._pairs(ngram_join._blocks(source, 3, 90, 100), nodes, 90, 100).collect()
    assert sum(p["wide"] for p in pairs) <= 1.1 * nodes.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(docs, 3, 90, 100).collect()}
    assert found == brute_components(texts, 3, 90, 100)


@pytest.mark.parametrize("small", [1, 2, 100])
def test_blocks_of_any_size(spark, monkeypatch, small):
    """The components do not depend on which blocks have a hub."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rng = random.Random(small)
    texts = []
    for size in (12, 60, 150):
        words = [f"w{rng.randrange(900)}" for _ in range(size)]
        for _ in range(25):
            texts.append(" ".join(w if rng.random() > 0.03 else f"x{rng.randrange(50)}" for w in words))
    rows = ngram_join.jaccard_join(docs_of(spark, texts), 3, 80, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, 3, 80, 100)


def test_keep_one(spark):
    long = " ".join(str(i) for i in range(60))
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, None), (5, long), (5, long), (6, long + " x"), (None, long), (None, "q r s t u v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("extra"))
    left = ngram_join.keep_one(docs, ngram_join.jaccard_join(docs, 5, 80, 100))
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted(
        [("1", rows[0][1]), ("3", ""), ("4", ""), ("5", long), ("None", rows[-1][1])])
    none = docs.limit(0)
    assert ngram_join.keep_one(none, ngram_join.jaccard_join(none)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and set(root) - set(got) <= {a for a, b in edges if a == b}


def test_hashes_are_stable():
    assert hashlib.sha256(ngram_join.ngrams(b"One two THREE four", 3).tobytes()).hexdigest() == hashlib.sha256(
        ngram_join.ngrams(b"one\ttwo three\nfour", 3).tobytes()).hexdigest()
