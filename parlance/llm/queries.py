"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    decontaminate,
    exact_duplicates,
    filter_audit,
    language,
    licenses,
    mixing,
    near_duplicates,
    packing,
    pii,
    quality,
    token_counts,
    tokens,
    url_filter,
    whitening,
)
from parlance.runtime import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8, words=4)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(tokens.flat_blocks(_table(spark, sf_dir, "documents")))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    crf = pii.fit_crf(pii.labelled_examples())
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"), crf)
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
        F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix_sources(_table(spark, sf_dir, "documents")))


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_trigrams(language.training_rows(_table(spark, sf_dir, "documents")))
    return language.identify(_table(spark, sf_dir, "pages"), model)


#: The contract's rules: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), RULES)
    return judged.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})  # as they are shown, not as they are compared


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(quality.training_rows(documents, labels.where(quality.learnable())))
    scored = quality.score_documents(documents.select("doc_id", "text"), model)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_token_counts": op2_token_counts,
        "op3_personal_data": op3_personal_data,
        "op4_packing": op4_packing,
        "op5_mixing": op5_mixing,
        "op6_exact_duplicates": op6_exact_duplicates,
        "op7_language": op7_language,
        "op8_url_filter": op8_url_filter,
        "op9_quality": op9_quality,
        "op10_decontamination": op10_decontamination,
        "op11_filter_audit": op11_filter_audit,
        "op12_whitening": op12_whitening,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": _NEAR_SQL, "op6_exact_duplicates": _EXACT_SQL, "op8_url_filter": _url_sql(), "op10_decontamination": _WINDOW_SQL, "op11_filter_audit": _AUDIT_SQL, "op13_license_scan": _license_sql()}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce("""
    + _LOWER.format("text")
    + r""", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
ends AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ends.y, r.root FROM r JOIN ends ON r.doc_id = ends.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
)

_WORDS = "regexp_extract_all(coalesce(" + _LOWER.format("text") + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WINDOW_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(body) AS text_sha256
FROM d
"""


def _propagation(name: str, edges: str, seeds: str) -> str:
    """CTEs up to ``name`` (host, score): flows round after round until they vanish."""
    return f"""
{name}_out AS (SELECT src, sum(weight) AS total, 0.85::DOUBLE * sum(weight) FILTER (src = dst) / sum(weight) AS loop FROM {edges} GROUP BY src),
{name}_share AS (SELECT src, dst, weight / total * 0.85::DOUBLE / (1 - coalesce(loop, 0)) AS share FROM {edges} JOIN {name}_out USING (src) WHERE src <> dst),
{name}_flow AS (
  SELECT 0 AS round, host, seed / (SELECT sum(seed) FROM {seeds}) AS flow FROM {seeds}
  UNION ALL
  SELECT round + 1, dst, sum(flow * share) FROM {name}_flow JOIN {name}_share ON host = src GROUP BY round, dst HAVING sum(flow * share) > 1e-300),
{name}_all AS (SELECT host, sum(flow) * 0.15::DOUBLE / (1 - coalesce(any_value(loop), 0)) AS score FROM {name}_flow LEFT JOIN {name}_out ON host = src GROUP BY host),
{name} AS (SELECT host, score / (SELECT sum(score) FROM {name}_all) AS score FROM {name}_all)"""


def _url_sql() -> str:
    host = lambda rest: f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = lambda url: f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    link = url_filter.LINK.replace("'", "''").replace("*+", "*").replace("?+", "?")
    return f"""
WITH RECURSIVE u AS (SELECT page_id, html, {rest("url")} AS rest FROM pages),
p AS (SELECT page_id, html, {host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES {rules}) v(verdict, h, pre)),
ruled AS (SELECT page_id, p.host, path, r.rule, r.verdict FROM p LEFT JOIN LATERAL (SELECT h || pre AS rule, verdict FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(path, pre) ORDER BY length(h) + length(pre) DESC, length(h) DESC LIMIT 1) r ON true),
links AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS t FROM p),
linked AS (SELECT src, CASE WHEN regexp_matches(t, '^(?i)([a-z][a-z0-9+.-]*:)?//') THEN {host(rest("CASE WHEN starts_with(t, '//') THEN 'x:' || t ELSE t END"))} WHEN NOT regexp_matches(t, '^(?i)[a-z][a-z0-9+.-]*:') THEN src END AS dst FROM links),
edges AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM linked WHERE src <> '' AND dst <> '' GROUP BY ALL),
turned AS (SELECT dst AS src, src AS dst, weight FROM edges),
good AS (SELECT host, count(*)::DOUBLE AS seed FROM ruled WHERE verdict = 'allow' GROUP BY host),
bad AS (SELECT host, count(*)::DOUBLE AS seed FROM ruled WHERE verdict = 'block' GROUP BY host),
{_propagation("tr", "edges", "good")},
{_propagation("di", "turned", "bad")},
scored AS (SELECT page_id, r.host, path, rule, verdict, coalesce(tr.score, 0.0::DOUBLE) AS trust, coalesce(di.score, 0.0::DOUBLE) AS distrust FROM ruled r LEFT JOIN tr ON tr.host = r.host LEFT JOIN di ON di.host = r.host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust > trust * (1 + {url_filter.MARGIN}) THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN trust + distrust > 0 THEN 'links' ELSE 'nothing' END AS decided_by, round(trust, 9) AS trust, round(distrust, 9) AS distrust
FROM scored
"""


_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
j AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 50, 100 * list_unique(w) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM w LEFT JOIN marks USING (doc_id)),
v AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM j GROUP BY ALL),
f(k) AS (SELECT unnest([1, 2, 3, 4, 5])),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM f a, f b, f c, f d, f e WHERE list_unique([a.k, b.k, c.k, d.k, e.k]) = 5),
s AS (
  SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step, o[step] AS k, n, good, toxic, fails[o[step]] AS hit,
         list_count(list_filter(o[1 : step - 1], lambda x: fails[x])) > 0 AS gone, list_count(list_filter(fails, lambda x: x)) AS failed
  FROM v, o, f AS steps(step)),
g AS (
  SELECT part, filter_order, step, k, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
         sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (hit AND failed = 1) AS unique_fails,
         sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM g
"""


def _license_sql() -> str:
    """Votes of word pairs by diagonal; pairs are compared as they are."""
    listed = licenses.NAMES + licenses.NOTICES
    rows = ", ".join(f"({k}, '{t.label}', '{' '.join(t.words)}', {t.threshold}::DOUBLE)" for k, t in enumerate(listed))
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(template, label, phrase, threshold)),
tw AS (SELECT *, string_split(phrase, ' ') AS w FROM t),
tg AS (SELECT template, label, threshold, len(w) AS size, len(w) - 1 AS grams, CASE WHEN threshold >= 1 THEN 0 ELSE greatest(1, len(w) // 5) END AS slack, i - 1 AS tpos, w[i] || ' ' || w[i + 1] AS gram
       FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tw)),
d AS (SELECT doc_id, row_number() OVER () AS nr, {_WORDS} AS w FROM documents),
dg AS (SELECT nr, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT nr, w, unnest(range(1, len(w))) AS i FROM d)),
lines AS (
  SELECT nr, template, label, threshold, size, grams, slack, pos - tpos AS diagonal, min(pos) AS first, max(pos) + 1 AS last, list(tpos) AS covered
  FROM dg JOIN tg USING (gram) GROUP BY ALL HAVING count(*) >= least(2, grams)),
marked AS (SELECT *, len(covered) >= threshold * grams AS alone, coalesce(diagonal - lag(diagonal) OVER along > slack, true) AS apart FROM lines WINDOW along AS (PARTITION BY nr, template ORDER BY diagonal)),
cut AS (SELECT *, apart OR alone OR coalesce(lag(alone) OVER along, false) AS starts FROM marked WINDOW along AS (PARTITION BY nr, template ORDER BY diagonal)),
grouped AS (SELECT *, sum(starts::INT) OVER (PARTITION BY nr, template ORDER BY diagonal) AS span FROM cut),
spans AS (
  SELECT nr, template, label, threshold, size, span, min(first) AS first, max(last) AS last, list_unique(flatten(list(covered))) / any_value(grams)::DOUBLE AS coverage
  FROM grouped GROUP BY nr, template, label, threshold, size, span),
places AS (SELECT *, template < {len(licenses.NAMES)} AS base FROM spans WHERE coverage >= threshold AND last - first < {licenses.STRETCH} * size),
sums AS (
  SELECT nr, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, max(coverage) AS score,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY nr)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN sums USING (nr)
"""
