"""A corpus pipeline: every stage is one operator of triagemill.llm, applied to what the stage before has kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir).  ``run`` writes each stage's rows to the
shared folder and rereads them for the next.  All stages but the last return the columns of their input, whatever their
names are, unchanged.

A stage's result is to be written before the next stage is called: the tables a stage has settled on its way are dropped
when the next one starts, so the scratch of one stage alone takes up space.

Cases: an empty table gives an empty one at every stage.  A null or empty text is scored as
a text without words, is near to nothing, has no benchmark words, counts no words in the mix (and is taken as its hash
says, like others of its source), and gives the end id alone.  A null id is an id like others; a null source is a source.  Rows
that repeat in id and text are near copies: one stays.  Texts are never cut.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.llm import decontam, mixing, ngram_join, tokenbin, toxicity
from triagemill.llm.common import free_prefix, sent
from triagemill.session import collecting, drop_scratch, settle

# the toxicity model, the hubs of the join and the byte formats have no SQL form
ORACLE_SQL = None


_used_up: list[str] = []  # settled tables of the stage before


def stage(fn):
    """A stage that first drops what the stage before has settled."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, _used_up)
        with collecting(_used_up):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.fit(toxicity.training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.drop_toxic(docs, model)


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return ngram_join.keep_one(docs, ngram_join.jaccard_join(docs, 5, 80, 100))


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter(decontam.contaminated(F.col("n_hit"), F.col("n_words")))
    own = free_prefix(docs.columns)
    bad = bad.select(F.col("doc_id").alias(f"{own}id"), F.col("text_key").alias(f"{own}key"))
    bad = sent(settle(bad.distinct(), "contaminated"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64("text") == F.col(f"{own}key")), "left_anti")


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    own = free_prefix(docs.columns)
    rows = mixing.apply_mix(docs, mixing.mix_plan(docs, (1, 2, 3), 3), prefix=own).filter(F.col(f"{own}copies") > 0)
    times = F.explode(F.sequence(F.lit(1), F.col(f"{own}copies").cast("int"))).alias(f"{own}copy")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*names, times).select(*names)


@stage
def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards, read back: doc_id, start, n_tokens, ids_crc32 of every row."""
    return tokenbin.read_tokens(spark, tokenbin.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_copies),
    ("benchmark_decontamination", without_benchmark),
    ("source_mix", mixed),
    ("token_shards", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
