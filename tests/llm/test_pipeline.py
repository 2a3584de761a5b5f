"""The pipeline's stages against plain Python on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_text_operators import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


def plain_mix(rows, weights=(1, 2, 3), most=3):
    """doc_id -> copies: targets by weight up to ``most`` times a source, whole copies, then the smallest hashes."""
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    total, weight = Counter(), {}
    for r in rows:
        total[r["source"]] += size[id(r)]
    for i, s in enumerate(sorted(total)):
        weight[s] = weights[i % len(weights)]
    full, budget = set(), sum(total.values())
    while True:
        left = budget - sum(most * total[s] for s in full)
        parts = sum(weight[s] for s in total if s not in full)
        over = {s for s in total if s not in full and most * total[s] * parts < weight[s] * left}
        if not over:
            break
        full |= over
    copies = Counter()
    for s in total:
        own = [r for r in rows if r["source"] == s]
        target = Fraction(most * total[s]) if s in full else Fraction(weight[s] * left, parts)
        base = int(target // total[s]) if total[s] else 0
        rest, before = target - base * total[s], 0
        extra = set()
        for r in sorted(own, key=lambda r: int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16)):
            if rest > 0 and 2 * before + size[id(r)] <= 2 * rest:
                extra.add(id(r))
            before += size[id(r)]
        for r in own:
            copies[r["doc_id"]] += base + (id(r) in extra)
    return +copies


def test_names_do_not_clash(spark):
    """Columns with the names that the stages use come through unchanged."""
    extra = ["_id", "_key", "_h", "_copy", "size", "source_size", "target", "copies", "text_key", "id", "h", "own", "doc", "base", "limit", "group"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = corpus_pipeline.settle(docs.unionByName(docs.limit(5)).select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in extra]), "docs")
    for name, fn in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.settle(fn(spark, docs, SF), name)
        assert docs.columns[-len(extra):] == extra
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra)


def test_scratch_of_a_stage_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    corpus_pipeline.settle(corpus_pipeline.without_benchmark(spark, docs, SF), "one")
    before = list(corpus_pipeline._used_up)
    assert before and all(spark.read.parquet(p).columns for p in before)
    corpus_pipeline.settle(corpus_pipeline.mixed(spark, docs, SF), "two")
    assert not any(Path(p.removeprefix("file:")).exists() for p in before)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SF)
        kept.append(corpus_pipeline.settle(out, name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == columns
    texts = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept[:5]]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    gone = set(texts[0]) - set(texts[1])
    # a dozen toxic texts are little to learn from; accuracy is tested with test_toxicity
    assert len(toxic & set(texts[1])) <= 0.5 * len(toxic) and len(gone) < 0.25 * len(texts[0])
    keys = sorted(texts[1])
    parts = brute_components([texts[1][k] for k in keys], 5, 80, 100)
    first = {}
    for i, (n, root) in parts.items():
        first.setdefault(root if n else ("own", i), keys[i])
    assert set(texts[2]) == set(first.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for k, t in texts[2].items():
        n, hit, _ = brute_hits(t, items)
        if not (hit and 20 * hit >= n):
            clean.add(k)
    assert set(texts[3]) == clean
    # every document of the mix, copies included, as the plain rule takes it
    assert Counter(r["doc_id"] for r in kept[4].collect()) == plain_mix(kept[3].collect())
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    want = []
    for r in sorted(kept[4].collect(), key=lambda r: r["doc_id"]):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in kept[5].collect())
    assert got == sorted(want)
