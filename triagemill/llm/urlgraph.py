"""URL filters: rules first, then the link graph of hosts.

A page is judged by the longest rule that fits its host (or a parent domain) and begins its path.  Pages without a rule
are judged by their host: trust flows along links from hosts whose pages rules allow, distrust flows against the links
from hosts whose pages rules block (who links to a bad host is suspect).  Both are personalised PageRanks over distinct
host edges; a seed's weight is the share of its pages that the rules allow or block.  A host is blocked when its
distrust exceeds its trust by more than ``threshold``, on the scale where a wholly listed host has 1.  Rounds go on until
the scores of all hosts together change by no more than ``epsilon``; no score then lacks more than
``epsilon * damping / (1 - damping)``.

Cases: a null url or one without ``://`` has an empty host and path, which no rule and no link concerns; null html has
no links; links of a host to itself are dropped; repeated rows are judged each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.llm.common import UPPER, sent
from triagemill.session import settle

LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>\\]+)"
DAMPING, EPSILON, THRESHOLD = 0.85, 1e-6, 0.5
ROUNDS = 10  # of the SQL text, which cannot go on until nothing changes


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path with the longest fitting rule (``rule``, ``ruled``); rules have host, path, verdict.

    Every parent domain is paired with every path beginning of a length that some rule has, and looked up by equality.
    """
    rules = settle(rules.dropDuplicates(["host", "path"]), "rules")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # path lengths: some dozens
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn(
        "_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths])) if lengths else F.array(F.lit(""))
    asked = rows.withColumn("_parent", F.explode(parents)).withColumn("_head", F.explode(heads))
    table = rules.select(F.col("host").alias("_parent"), F.col("path").alias("_head"), "verdict")
    found = asked.join(sent(table), ["_parent", "_head"], "left")
    rule = F.concat("_parent", "_head")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(
        F.length(rule).alias("size"), F.length("_parent").alias("host_size"), rule.alias("rule"), "verdict")))
    return found.groupBy("_row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("_b")
    ).select("page_id", "host", "path", F.col("_b.rule").alias("rule"), F.col("_b.verdict").alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) between different hosts."""
    to = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))))
    links = pages.select(host_of(F.col("url")).alias("src"), to.alias("_to"))
    links = links.select("src", F.translate("_to", UPPER, UPPER.lower()).alias("dst"))
    return links.filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).distinct()


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, epsilon: float = EPSILON) -> DataFrame:
    """``trust`` and ``distrust`` of every host that a seed reaches; seeds have host, trust, distrust."""
    sides = links.select(F.lit("trust").alias("side"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(
        links.select(F.lit("distrust").alias("side"), F.col("dst").alias("a"), F.col("src").alias("b")))
    sides = settle(sides, "links")
    degree = sides.groupBy("side", "a").agg(F.count(F.lit(1)).alias("out"))
    edges = settle(sides.join(degree, ["side", "a"]), "edges")
    start = settle(seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (side, weight)")).filter(
        "weight > 0"), "seeds")
    score = start.select("side", "host", F.col("weight").alias("score"))
    total = (start.agg(F.sum("weight")).first()[0] or 0.0) if edges.take(1) else 0.0  # without links the seeds are all
    # round n moves at most total * damping^n, so that the last of these is below epsilon whatever the links are
    for _ in range(math.ceil(math.log(epsilon / total, damping)) if total > epsilon else 0):
        moved = edges.join(score.withColumnRenamed("host", "a"), ["side", "a"]).select(
            "side", F.col("b").alias("host"), (F.lit(damping) * F.col("score") / F.col("out")).alias("score"))
        score = settle(
            start.select("side", "host", F.col("weight").alias("score")).unionByName(moved)
            .groupBy("side", "host").agg(F.sum("score").alias("score")), "score")
        before, total = total, score.agg(F.sum("score")).first()[0]
        if total - before <= epsilon:  # scores only grow
            break
    return score.groupBy("host").agg(*[
        F.coalesce(F.sum(F.when(F.col("side") == s, F.col("score"))), F.lit(0.0)).alias(s) for s in ("trust", "distrust")])


def judge_urls(pages: DataFrame, rules: DataFrame, damping: float = DAMPING, epsilon: float = EPSILON,
               threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule (or null) and verdict of every page, with the host's trust and distrust."""
    matched = settle(match_rules(pages, rules), "matched")
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = matched.filter("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = settle(spread(host_links(pages), seeds, damping, epsilon), "hosts")
    judged = matched.join(sent(scores), "host", "left")
    gap = F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(gap > threshold, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
