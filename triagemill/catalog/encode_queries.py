"""Codes, scaling and vectors (C)."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.catalog.soc_queries import rounded
from triagemill.constants import CALENDAR, CATEGORICALS, OBSERVATION
from triagemill.functions.missing import calendar_features
from triagemill.operators import encode as N

BOOK = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", v AS value, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce({c}, 'Unknown') AS v FROM train)"""
    for c in CATEGORICALS)


@query("C1_fit_codebook", BOOK)
def c1(v):
    return N.fit_codebook(v.train(), CATEGORICALS)


CODE = "coalesce((SELECT code FROM book b WHERE b.\"column\" = '{c}' AND b.value = coalesce(a.{c}, 'Unknown')), -1) AS {c}_code"
TOP = "(SELECT max(code) + 1 FROM book WHERE \"column\" = '{c}')"


@query("C2_apply_codebook", f"WITH book AS ({BOOK}) SELECT alert_id, {', '.join(CODE.format(c=c) for c in ('category', 'mitre', 'threat_family'))} FROM test a")
def c2(v):
    book = N.fit_codebook(v.train(), CATEGORICALS)
    names = ["category", "mitre", "threat_family"]
    return N.apply_codebook(v.test(), book, names).select("alert_id", *[f"{c}_code" for c in names])


@query("C3_apply_codebook_bucketed", f"""
WITH book AS ({BOOK}), coded AS (SELECT alert_id, k, {', '.join(CODE.format(c=c) for c in ('category', 'mitre', 'threat_family'))} FROM test a)
SELECT alert_id, {', '.join(f"round(CASE WHEN {c}_code < 0 THEN {TOP.format(c=c)} ELSE {c}_code END / greatest(1, {TOP.format(c=c)})::DOUBLE, 6) AS {c}_code" for c in ('category', 'mitre', 'threat_family'))} FROM coded""")
def c3(v):
    book = N.fit_codebook(v.train(), CATEGORICALS)
    names = ["category", "mitre", "threat_family"]
    return rounded(N.apply_codebook_bucketed(v.test(), book, names).select("alert_id", *[f"{c}_code" for c in names]))


@query("C6_fit_minmax", """
SELECT min(hour(ts))::DOUBLE AS hour_min, max(hour(ts))::DOUBLE AS hour_max, min(day(ts))::DOUBLE AS day_min, max(day(ts))::DOUBLE AS day_max, min(value) AS value_min, max(value) AS value_max FROM train""")
def c6(v):
    r = N.fit_minmax(calendar_features(v.train()), ["hour", "day", "value"])
    return r.select(*[F.col(c)[m].alias(f"{c}_{m}") for c in ("hour", "day", "value") for m in ("min", "max")])


@query("C7_apply_minmax", """
WITH r AS (SELECT min(hour(ts)) AS h0, max(hour(ts)) AS h1, min(day(ts)) AS d0, max(day(ts)) AS d1, min(value) AS v0, max(value) AS v1 FROM train)
SELECT alert_id, round((hour(ts) - h0) / (h1 - h0)::DOUBLE, 6) AS hour_scaled, round((day(ts) - d0) / (d1 - d0)::DOUBLE, 6) AS day_scaled,
  0e0 AS month_scaled, round((value - v0) / (v1 - v0), 6) AS value_scaled FROM test, r""")
def c7(v):
    names = ["hour", "day", "month", "value"]
    ranges = N.fit_minmax(calendar_features(v.train()), names)
    out = N.apply_minmax(calendar_features(v.test()), ranges, names)
    return rounded(out.select("alert_id", *[f"{c}_scaled" for c in names]))


@query("C8_zscore", """
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, avg(k) AS mk, stddev_pop(k) AS dk FROM train)
SELECT alert_id, round((value - m) / d, 6) AS value_z, round((k - mk) / dk, 6) AS k_z, 0e0 AS same_z FROM test, s""")
def c8(v):
    stats = N.fit_zscore(v.train().withColumn("same", F.lit(4.0)), ["value", "k", "same"])
    out = N.apply_zscore(v.test().withColumn("same", F.lit(4.0)), stats, ["value", "k", "same"])
    return rounded(out.select("alert_id", "value_z", "k_z", "same_z"))


@query("C9_assemble_state", f"""
WITH book AS ({BOOK}), coded AS (SELECT alert_id, ts, {', '.join(CODE.format(c=c) for c in CATEGORICALS)} FROM test a)
SELECT alert_id, 11::BIGINT AS size, round({' + '.join(f'{i + 1} * {c}_code' for i, c in enumerate(CATEGORICALS))}
  + 8 * hour(ts) + 9 * day(ts) + 10 * month(ts) + 11 * (isodow(ts) >= 6)::INT, 6)::DOUBLE AS weighted_sum FROM coded""")
def c9(v):
    book = N.fit_codebook(v.train(), CATEGORICALS)
    coded = N.apply_codebook(calendar_features(v.test()), book, CATEGORICALS)
    coded = N.assemble_state(coded, [f"{c}_code" for c in CATEGORICALS] + CALENDAR)
    weights = F.array(*[F.lit(float(i + 1)) for i in range(len(OBSERVATION))])
    dot = F.aggregate(F.zip_with("state", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rounded(coded.select("alert_id", F.size("state").cast("long").alias("size"), dot.alias("weighted_sum")))


HOT = ("category", "mitre", "suspicion", "os_family")
HOT_COUNTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS c, {o} AS o, coalesce({c}, 'Unknown') AS v, count(*) AS n FROM train GROUP BY ALL""" for o, c in enumerate(HOT))
HOT_ROWS = " UNION ALL ".join(f"SELECT alert_id, '{c}' AS c, coalesce({c}, 'Unknown') AS v FROM test" for c in HOT)


@query("C10_one_hot", f"""
WITH n AS ({HOT_COUNTS}),
b AS (SELECT c, o, v, CASE WHEN n > 1 THEN row_number() OVER (PARTITION BY c, n > 1 ORDER BY v) - 1
  ELSE count(*) FILTER (WHERE n > 1) OVER (PARTITION BY c) END AS i FROM n),
s AS (SELECT c, coalesce(sum(max(i) + 1) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, max(i) + 1 AS size FROM b GROUP BY c, o)
SELECT alert_id, (first + i)::BIGINT AS "index", 1e0 AS value FROM ({HOT_ROWS}) JOIN b USING (c, v) JOIN s USING (c)
UNION ALL SELECT alert_id, (SELECT sum(size) FROM s)::BIGINT, round(value, 6) FROM test WHERE value <> 0""")
def c10(v):
    """The cells of every vector that are not zero."""
    from pyspark.ml.functions import vector_to_array
    _, test = N.one_hot(v.train(), v.test(), [*HOT, "value"])
    cells = test.select("alert_id", F.posexplode(vector_to_array(F.col("features"))).alias("index", "value")).filter("value <> 0")
    return rounded(cells.select("alert_id", F.col("index").cast("long").alias("index"), "value"))
