"""Queries of error rates between a reference and a hypothesis."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from parlance.functions import text as tx
from parlance.operators import alignment, assignment, intervals as iv
from parlance.plans.texts import _WORDS_SQL, _hypothesis, _shipped
from parlance.plans.timelines import K, MERGED, TURNS, turns
from parlance.runtime import ship_package, spread


@F.pandas_udf(ArrayType(BooleanType()))
def _matched(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([alignment.matched_tokens(list(r), list(h)) for r, h in zip(ref, hyp, strict=True)])


def matched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each line its altered form meets, and of every third word (the tagged ones, each a word of its own)."""
    ship_package(spark)
    words = F.transform(tx.words(F.col("text")), lambda w, i: F.when(i % 3 == 0, F.concat(w, F.lit("_"), i.cast("string"))).otherwise(w))
    lines = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", words.alias("ref"))
    m = lines.withColumn("ok", _matched("ref", _hypothesis(F.col("ref"))))
    count = lambda a: F.size(F.filter(a, lambda x: x)).cast("long")
    tagged = F.filter("ok", lambda x, i: i % 3 == 0)
    return m.select(
        "conv_id",
        "turn",
        count(F.col("ok")).alias("matched"),
        count(tagged).alias("tagged_matched"),
        F.size(tagged).cast("long").alias("tagged"),
    )


def speaker_texts(lines: DataFrame, speaker: str) -> DataFrame:
    """(conv_id, speaker, words): each speaker's words in order of time."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "w")))
    return lines.groupBy("conv_id", F.col(speaker).alias("speaker")).agg(F.flatten(F.transform(ordered, lambda x: x["w"])).alias("words"))


def cp_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the best assignment of hypothesis speakers to reference speakers in each conversation."""
    lines = _shipped(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", tx.words(F.col("text")).alias("w"))
    swapped = F.when(F.col("turn") % 5 == 0, F.when(F.col("role") == "user", "assistant").otherwise("user")).otherwise(F.col("role"))
    ref = speaker_texts(lines, "role")
    hyp = speaker_texts(lines.withColumn("role2", swapped).withColumn("w", _hypothesis(F.col("w"))), "role2")
    best = assignment.cp_errors(ref, hyp, ["conv_id"])
    return best.select("conv_id", "errors", "mapped", "n_ref", F.expr("errors * 1000000 div greatest(n_ref, 1)").alias("rate_ppm"))


def _sides(spark: SparkSession, sf_dir: str, labels: int) -> tuple[DataFrame, DataFrame]:
    """Turns of ``labels`` speakers, merged, and the same late, without every fifth and with speakers moved by one."""
    user = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.expr(f"cast((user_id div 8) % {labels} as int)").alias("label"))
    own = turns(spark, sf_dir).drop("label", "speaker").join(user, "seq")
    named = lambda df: iv.merge_turns(df.withColumn("speaker", F.col("label").cast("string")), K, order="seq").where("end > start")
    moved = own.where("seq % 5 <> 0").withColumn("label", (F.col("label") + 1) % labels)
    moved = moved.withColumn("start", F.col("start") + 500).withColumn("end", F.col("end") + 500)
    return tuple(named(df).select("rec_id", F.col("speaker").alias("label"), "start", "end") for df in (own, moved))


def _der(spark: SparkSession, sf_dir: str, labels: int) -> DataFrame:
    d = assignment.der_parts(*_sides(spark, sf_dir, labels), K).withColumn("confusion", F.col("paired") - F.col("matched"))
    return d.select(
        "rec_id",
        "total",
        "missed",
        "false_alarm",
        "confusion",
        F.expr("(missed + false_alarm + confusion) * 1000000 div greatest(total, 1)").alias("der_ppm"),
    )


def _jer(spark: SparkSession, sf_dir: str, labels: int) -> DataFrame:
    error = F.expr("(own + other - 2 * shared) * 1000000 div greatest(own + other - shared, 1)")
    own = assignment.jaccard_parts(*_sides(spark, sf_dir, labels), K).withColumn("e", error)
    return own.groupBy("rec_id").agg(F.expr("sum(e) div count(*)").alias("jer_ppm"), F.count("*").alias("speakers"))


def der_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed, false alarm and confused time of each recording, and their share of the reference."""
    return _der(spark, sf_dir, 3)


def jer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Jaccard error of the reference speakers under the mapping of most shared time."""
    return _jer(spark, sf_dir, 3)


def der_five_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``der_components`` where recordings have up to five speakers."""
    return _der(spark, sf_dir, 5)


def jer_five_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``jer`` where recordings have up to five speakers."""
    return _jer(spark, sf_dir, 5)


def _der_sql(labels: int) -> str:
    told = TURNS.replace("% 3)", f"% {labels})") + MERGED
    perms = ", ".join(f"({k}, {list(p)})" for k, p in enumerate(itertools.permutations(range(labels))))
    return told + f""", hm AS (SELECT rec_id, (label + 1) % {labels} AS label, s + 500 AS s, e + 500 AS e, seq FROM turns WHERE seq % 5 <> 0),
h0 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec_id, label ORDER BY s, e, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hm),
h1 AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id, label ORDER BY s, e, seq ROWS UNBOUNDED PRECEDING) AS island FROM h0),
hyp AS (SELECT rec_id, label, min(s) AS s, max(e) AS e FROM h1 GROUP BY rec_id, label, island HAVING max(e) > min(s)),
ref AS (SELECT rec_id, label, s, e FROM merged WHERE e > s),
pts AS (SELECT DISTINCT rec_id, unnest([s, e]) AS t FROM (SELECT rec_id, s, e FROM ref UNION ALL SELECT rec_id, s, e FROM hyp)),
sl AS (SELECT rec_id, t AS a, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS b FROM pts),
rc AS (SELECT sl.rec_id, a, b, count(ref.s) AS r FROM sl LEFT JOIN ref ON ref.rec_id = sl.rec_id AND ref.s <= a AND ref.e >= b WHERE b IS NOT NULL GROUP BY ALL),
hc AS (SELECT sl.rec_id, a, count(hyp.s) AS h FROM sl LEFT JOIN hyp ON hyp.rec_id = sl.rec_id AND hyp.s <= a AND hyp.e >= b WHERE b IS NOT NULL GROUP BY ALL),
p AS (SELECT rec_id, sum((b - a) * r)::BIGINT AS total, sum((b - a) * greatest(0, r - h))::BIGINT AS missed, sum((b - a) * greatest(0, h - r))::BIGINT AS false_alarm, sum((b - a) * least(r, h))::BIGINT AS paired FROM rc JOIN hc USING (rec_id, a) GROUP BY rec_id),
ol AS (SELECT ref.rec_id, ref.label AS i, hyp.label AS j, sum(least(ref.e, hyp.e) - greatest(ref.s, hyp.s))::BIGINT AS ms FROM ref JOIN hyp ON ref.rec_id = hyp.rec_id AND ref.s < hyp.e AND ref.e > hyp.s GROUP BY ALL),
pm AS (SELECT * FROM (VALUES {perms}) v(k, m)),
sc AS (SELECT p.rec_id, k, m, coalesce(sum(ms), 0)::BIGINT AS matched FROM p CROSS JOIN pm LEFT JOIN ol ON ol.rec_id = p.rec_id AND ol.j = m[ol.i + 1] GROUP BY ALL),
bm AS (SELECT rec_id, m, matched FROM sc QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY matched DESC, k) = 1)
"""


QUERIES = {f.__name__: f for f in (matched_tokens, cp_error, der_components, jer, der_five_speakers, jer_five_speakers)}
#: Edits by words, an oblique line of the table of edits per round, from the two before it; then every order of the speakers.
_CP_SQL = f"""WITH RECURSIVE l AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 0 THEN CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END ELSE role END AS role2, {_WORDS_SQL} AS w FROM conversations),
h AS (SELECT conv_id, turn, role2, [CASE WHEN i % 5 = 0 THEN '##' ELSE w[i] END FOR i IN range(1, len(w) + 1) IF i % 7 <> 0] AS w FROM l),
r1 AS (SELECT conv_id, role AS s, flatten(list(w ORDER BY turn)) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY role) AS k FROM l GROUP BY conv_id, role),
h1 AS (SELECT conv_id, role2 AS s, flatten(list(w ORDER BY turn)) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY role2) AS k FROM h GROUP BY conv_id, role2),
sides AS (SELECT conv_id, greatest(count(DISTINCT r1.s), count(DISTINCT h1.s)) AS n FROM r1 JOIN h1 USING (conv_id) GROUP BY conv_id),
slots AS (SELECT conv_id, n, unnest(range(1, n + 1)) AS k FROM sides),
pairs AS (
  SELECT a.conv_id, a.n, a.k AS i, b.k AS j, r1.s IS NOT NULL AND h1.s IS NOT NULL AS mapped, coalesce(r1.w, []) AS rw, coalesce(h1.w, []) AS hw, row_number() OVER () AS id
  FROM slots a JOIN slots b ON a.conv_id = b.conv_id LEFT JOIN r1 ON r1.conv_id = a.conv_id AND r1.k = a.k LEFT JOIN h1 ON h1.conv_id = b.conv_id AND h1.k = b.k),
names AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY w) AS c FROM (SELECT conv_id, unnest(rw) AS w FROM pairs UNION SELECT conv_id, unnest(hw) FROM pairs)),
rc AS (SELECT id, list(c ORDER BY place) AS rw FROM (SELECT id, conv_id, unnest(rw) AS w, generate_subscripts(rw, 1) AS place FROM pairs) JOIN names USING (conv_id, w) GROUP BY id),
hc AS (SELECT id, list(c ORDER BY place) AS hw FROM (SELECT id, conv_id, unnest(hw) AS w, generate_subscripts(hw, 1) AS place FROM pairs) JOIN names USING (conv_id, w) GROUP BY id),
coded AS MATERIALIZED (SELECT id, coalesce(rc.rw, []) AS rw, coalesce(hc.hw, []) AS hw FROM pairs LEFT JOIN rc USING (id) LEFT JOIN hc USING (id)),
dp(id, k, p2, p1) AS (
  SELECT id, 0, []::INT[], [0] FROM coded
  UNION ALL
  SELECT id, k + 1, p1, [CASE WHEN j = 0 OR j = k + 1 THEN k + 1 ELSE least(p1[j - lo] + 1, p1[j - lo + 1] + 1, p2[j - below] + (rw[k + 1 - j] <> hw[j])::INT) END FOR j IN range(greatest(0, k + 1 - len(rw)), least(k + 1, len(hw)) + 1)]
  FROM (SELECT dp.*, rw, hw, greatest(0, k - len(rw)) AS lo, greatest(0, k - 1 - len(rw)) AS below FROM dp JOIN coded USING (id) WHERE k < len(rw) + len(hw))),
dpe AS (SELECT id, p1[-1] AS d FROM dp JOIN coded USING (id) WHERE k = len(rw) + len(hw)),
cost AS (SELECT p.conv_id, n, i, p.j, mapped, d FROM pairs p JOIN dpe ON dpe.id = p.id),
way(conv_id, n, i, used, d, mapped) AS (
  SELECT conv_id, n, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT FROM sides
  UNION ALL
  SELECT way.conv_id, way.n, c.i, list_append(used, c.j), way.d + c.d, way.mapped + c.mapped::BIGINT FROM way JOIN cost c ON c.conv_id = way.conv_id AND c.i = way.i + 1 AND NOT list_contains(used, c.j)),
best AS (SELECT conv_id, min(d) AS errors, arg_min(mapped, d) AS mapped FROM way WHERE i = n GROUP BY conv_id),
size AS (SELECT conv_id, sum(len(w))::BIGINT AS n_ref FROM r1 GROUP BY conv_id)
SELECT conv_id, errors::BIGINT AS errors, mapped::BIGINT AS mapped, n_ref, (errors * 1000000 // greatest(n_ref, 1))::BIGINT AS rate_ppm FROM best JOIN size USING (conv_id)"""

_DER_TOTALS = "SELECT rec_id, total, missed, false_alarm, paired - matched AS confusion, (missed + false_alarm + paired - matched) * 1000000 // greatest(total, 1) AS der_ppm FROM p JOIN bm USING (rec_id)"
_JER_MEANS = """, rt AS (SELECT rec_id, label, sum(e - s)::BIGINT AS t FROM ref GROUP BY ALL), ht AS (SELECT rec_id, label, sum(e - s)::BIGINT AS u FROM hyp GROUP BY ALL),
x AS (SELECT rt.rec_id, t, coalesce(u, 0) AS u, coalesce(ms, 0) AS bo FROM rt JOIN bm USING (rec_id) LEFT JOIN ht ON ht.rec_id = rt.rec_id AND ht.label = m[rt.label + 1] LEFT JOIN ol ON ol.rec_id = rt.rec_id AND i = rt.label AND j = m[rt.label + 1])
SELECT rec_id, (sum((t + u - 2 * bo) * 1000000 // greatest(t + u - bo, 1)) // count(*))::BIGINT AS jer_ppm, count(*) AS speakers FROM x GROUP BY rec_id"""

ORACLES = {
    # Every seventh word is left out and every other fifth one replaced; a tagged word can only meet itself.
    "matched_tokens": f"WITH w AS (SELECT conv_id, turn, len({_WORDS_SQL}) AS n FROM conversations) SELECT conv_id, turn, n - n // 7 - n // 5 + n // 35 AS matched, len(list_filter(range(0, n, 3), lambda i: (i + 1) % 7 <> 0 AND (i + 1) % 5 <> 0)) AS tagged_matched, (n + 2) // 3 AS tagged FROM w",
    "cp_error": _CP_SQL,
    "der_components": _der_sql(3) + _DER_TOTALS,
    "jer": _der_sql(3) + _JER_MEANS,
    "der_five_speakers": _der_sql(5) + _DER_TOTALS,
    "jer_five_speakers": _der_sql(5) + _JER_MEANS,
}
