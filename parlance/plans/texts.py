"""Queries over texts: lines, documents, pages and literal fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import languages, text as tx, transliterate
from parlance.operators import lexicon
from parlance.operators.ranking import global_row_number
from parlance.plans.conversations import _CLOCK, clocked_lines
from parlance.runtime import ship_package, spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines with times in seconds; lines without words are dropped after numbering."""
    lines = clocked_lines(spark, sf_dir).where(tx.normalise(F.col("text")) != "")
    start, end = F.col("start_ms") / 1000, F.col("end_ms") / 1000
    return lines.select(
        "conv_id",
        (F.col("turn") + 1).alias("line_id"),
        F.coalesce("role", F.lit("Speaker_?")).alias("speaker"),
        start.alias("start_s"),
        end.alias("end_s"),
        tx.clock(start).alias("from"),
        tx.clock(end).alias("to"),
        F.trim("text").alias("text"),
    )


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring form of every document and line, and of each document taken apart into letters and marks."""
    ship_package(spark)
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.lit("line").alias("kind"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "text",
    )
    docs = _docs(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    both = docs.unionByName(docs.select(F.lit("apart").alias("kind"), "id", apart.alias("text"))).unionByName(lines)
    return transliterate.composed(both, "text").select("kind", "id", tx.normalise(F.col("text")).alias("form"))


def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document: all, content, distinct content, and without immediate repeats."""
    d = _docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("t")).withColumn("c", tx.content_of(F.col("t")))
    return d.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size("c").cast("long").alias("n_content"),
        F.size(tx.distinct_in_order(F.col("c"))).cast("long").alias("n_distinct"),
        F.size(tx.without_repeats(F.col("t"))).cast("long").alias("n_without_repeats"),
    )


_SAMPLES = [
    (-1, "नमस्ते दुनिया"),
    (-2, "আমি বাংলায়"),
    (-3, "ਪੰਜਾਬੀ"),
    (-4, "ગુજરાતી"),
    (-5, "ଓଡ଼ିଆ"),
    (-6, "தமிழ்"),
    (-7, "తెలుగు"),
    (-8, "ಕನ್ನಡ"),
    (-9, "മലയാളം"),
    (-10, "اردو زبان"),
    (-11, "ᱥᱟᱱᱛᱟᱲᱤ"),
    (-12, "Hello world 123"),
    (-13, "कक তত"),
]


def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predominant script of every document and of one sample per script."""
    samples = spark.createDataFrame(_SAMPLES, "doc_id long, text string")
    return _docs(spark, sf_dir).select("doc_id", "text").unionByName(samples).select("doc_id", tx.script_of(F.col("text")).alias("script"))


def tag_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags and words for unheard speech."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", tx.clean_tags(F.col("html")).alias("clean"))


def bench_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without punctuation and symbols, and their English form."""
    return _docs(spark, sf_dir).select(
        "doc_id",
        tx.bench_form(F.col("text")).alias("bench"),
        F.length(tx.english_form(F.col("text"))).cast("long").alias("english_letters"),
    )


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens, longest acceptable translation and prompt line of every line."""
    lines = clocked_lines(spark, sf_dir)
    prompt = F.concat_ws(
        " | ",
        (F.col("turn") + 1).cast("string"),
        "role",
        F.concat(tx.clock(F.col("start_ms") / 1000), F.lit("-"), tx.clock(F.col("end_ms") / 1000)),
        "text",
    )
    return lines.select(
        "conv_id",
        "turn",
        tx.estimated_tokens(F.col("text")).alias("tokens"),
        tx.longest_translation(F.col("text")).alias("longest"),
        prompt.alias("prompt"),
    )


def render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript text of every conversation; lines without text are left out."""
    lines = clocked_lines(spark, sf_dir).where(F.trim("text") != "")
    line = F.concat(
        F.lit("["),
        tx.clock(F.col("start_ms") / 1000),
        F.lit(" - "),
        tx.clock(F.col("end_ms") / 1000),
        F.lit("] "),
        F.col("role"),
        F.lit(": "),
        F.col("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "turn", line.alias("line"))))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("transcript"))


def render_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles; numbers count all lines, so dropping empty ones leaves gaps."""
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("start_ms", "turn"))
    lines = clocked_lines(spark, sf_dir).withColumn("number", number).where(F.trim("text") != "")
    entry = F.concat(
        F.col("number").cast("string"),
        F.lit("\n"),
        tx.srt_time(F.col("start_ms")),
        F.lit(" --> "),
        tx.srt_time(F.col("end_ms")),
        F.lit("\n"),
        F.col("role"),
        F.lit(": "),
        F.col("text"),
    )
    return lines.select("conv_id", F.col("number").cast("long").alias("number"), entry.alias("entry"))


_WORDS = [
    ("বাংলা", "baanla"),
    ("ਪੰਜਾਬੀ", "panjabee"),
    ("ગુજરાતી", "gujaratee"),
    ("தமிழ்", "tamizh"),
    ("తెలుగు", "telugu"),
    ("ಕನ್ನಡ", "kannada"),
    ("മലയാളം", "malayalam"),
    ("اردو", "ardo"),
    ("پاکستان", "pakstan"),
    ("شکریہ", "shukriya"),
    ("ᱥᱟᱱᱛᱟᱲᱤ", "santari"),
    ("कमरा", "kamra"),
    ("समझना", "samajhna"),
    ("मतलब", "matlab"),
    ("बचपन", "bachpan"),
    ("पढ़ते", "padhte"),
    ("आपके", "aapke"),
    ("करना", "karna"),
    ("बात", "baat"),
    ("तीन", "teen"),
    ("दूध", "doodh"),
    ("था", "tha"),
    ("क्या", "kya"),
    ("हमारा", "hamara"),
    ("ज़मीन", "zamin"),
    ("फ़ायदा", "fayda"),
    ("कंबल", "kambal"),
    ("में", "mein"),
    ("नहीं", "nahi"),
    ("है", "hai"),
    ("شکریہ", "shukriya"),
]


def _shipped(spark: SparkSession) -> SparkSession:

    ship_package(spark)
    return spark


def romanise_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin forms of the fixture words."""
    words = _shipped(spark).createDataFrame([(w,) for w, _ in _WORDS], "word string")
    return words.select("word", transliterate.romaniser()(F.col("word")).alias("latin"))


def romaniser_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of fixture words whose Latin form equals the expected spelling."""
    words = _shipped(spark).createDataFrame(_WORDS, "word string, expected string")
    equal = tx.english_form(transliterate.romaniser()(F.col("word"))) == tx.english_form(F.col("expected"))
    return words.withColumn("equal", equal.cast("double")).agg(F.count("*").alias("n"), F.avg("equal").alias("accuracy"))


_NOTES = [("a", "स्मार्ट {smart} फोन"), ("b", "बोहोत {बहुत} अच्छा."), ("c", "<noise> हाँ [breath] ठीक -- है"), ("d", "plain words")]


def code_switch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and English spellings of transcripts with notes in braces."""
    rows = _shipped(spark).createDataFrame(_NOTES, "key string, raw string")
    parsed = rows.withColumn("p", transliterate.code_switches("raw"))
    return parsed.select("key", F.col("p.text").alias("text"), F.coalesce(F.try_element_at("p.english", F.lit(0)), F.lit("")).alias("first_english"))


_NAMES = [("bangla",), ("GOM",), ("oriya",), ("Hindi",), ("  ta ",), ("",), ("klingon",), ("ur",)]


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows for codes, names and aliases; unknown ones stay without."""
    asked = spark.createDataFrame(_NAMES, "asked string").withColumn("code", languages.language_code(F.col("asked")))
    return asked.join(F.broadcast(languages.catalogue(spark)), "code", "left").select("asked", "code", "name", "script", "latin_name", "has_ctc")


def _hypothesis(words):
    """The words without every seventh, and with every other fifth replaced."""
    kept = F.filter(
        F.transform(words, lambda w, i: F.when((i + 1) % 7 == 0, F.lit(None)).when((i + 1) % 5 == 0, F.lit("##")).otherwise(w)),
        lambda w: w.isNotNull(),
    )
    return kept


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", "role", tx.words(F.col("text")).alias("ref"))
    chars = F.array_join("ref", "")
    return lines.withColumn("hyp", _hypothesis(F.col("ref"))).select(
        "conv_id",
        "turn",
        "role",
        tx.word_edits(F.col("ref"), F.col("hyp")).alias("word_edits"),
        F.size("ref").cast("long").alias("words"),
        F.levenshtein(chars, F.replace(chars, F.lit("e"), F.lit(""))).cast("long").alias("char_edits"),
        F.length(chars).cast("long").alias("chars"),
    )


def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and character edits and rates of every line against its altered form."""
    return _scored(spark, sf_dir).withColumn("wer_ppm", F.expr("word_edits * 1000000 div greatest(words, 1)")).withColumn(
        "cer_ppm",
        F.expr("char_edits * 1000000 div greatest(chars, 1)"),
    )


def corpus_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled and mean rates of each role."""
    s = _scored(spark, sf_dir)
    return s.groupBy("role").agg(
        F.sum("word_edits").alias("edits"),
        F.sum("words").alias("words"),
        F.round(F.sum("word_edits") / F.greatest(F.sum("words"), F.lit(1)), 6).alias("pooled"),
        F.round(F.avg(F.col("char_edits") / F.greatest(F.col("chars"), F.lit(1))), 6).alias("mean_cer"),
    )


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence case, table-cell escape and collapsed form of every line."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id",
        "turn",
        tx.sentence(F.col("text")).alias("sentence"),
        tx.markdown_cell(F.col("text")).alias("cell"),
        tx.collapse(F.col("text")).alias("collapsed"),
    )


def recording_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of all recordings in order, without empty ones."""
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(tx.clean_tags(F.col("text")) != "")
    return lines.select(
        "conv_id",
        F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"),
        "turn",
        F.length("text").cast("long").alias("chars"),
    )


def unit_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut to sentences, each cleaned, and put together again in order; lines without a piece survive."""
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    pieces = lines.select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("piece", "t")).select(
        "conv_id",
        "turn",
        "piece",
        tx.collapse(F.col("t")).alias("t"),
    ).where("t <> ''")
    joined = pieces.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "t"))), lambda x: x["t"]), " ").alias("text"),
        F.count("*").alias("pieces"),
    )
    return lines.select("conv_id", "turn").join(joined, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("pieces", F.lit(0)).alias("pieces"),
    )


def keyword_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item, how many of its content words occur in any document."""
    said = _docs(spark, sf_dir).select(F.explode(tx.content_tokens(F.col("text"))).alias("word")).distinct().withColumn("said", F.lit(1))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id",
        F.explode(F.array_distinct(tx.content_tokens(F.col("text")))).alias("word"),
    )
    return items.join(said, "word", "left").groupBy("item_id").agg(F.count("*").alias("words"), F.count("said").alias("grounded")).withColumn(
        "all_grounded",
        F.col("words") == F.col("grounded"),
    )


def keyword_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set overlap of each document's content words with a benchmark item's; both empty is 1."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = bench.select("item_id", F.array_distinct(tx.content_tokens(F.col("text"))).alias("b"))
    docs = _docs(spark, sf_dir).select(
        "doc_id",
        (F.col("doc_id") % max(1, bench.count())).alias("item_id"),
        F.array_distinct(tx.content_tokens(F.col("text"))).alias("a"),
    )
    both = F.size(F.array_intersect("a", "b")).cast("long")
    total = F.size("a") + F.size("b")
    f1 = F.when(total == 0, 1_000_000).otherwise(F.expr("2 * size(array_intersect(a, b)) * 1000000L div greatest(size(a) + size(b), 1)"))
    return docs.join(items, "item_id").select(
        "doc_id",
        "item_id",
        both.alias("shared"),
        f1.cast("long").alias("f1_ppm"),
        (F.size(F.array_except("a", "b")) == 0).alias("contained"),
    )


def json_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of fenced replies, with aliases for the field."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.concat(F.lit("```json\nreply: "), F.col("props"), F.lit("\n```")).alias("reply"),
    )
    parsed = F.from_json(tx.json_object_text(F.col("reply")), "k long, key long")
    return e.withColumn("p", parsed).select("event_id", F.coalesce("p.k", "p.key").alias("value"))


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-first batches of 32 documents."""
    ranked = global_row_number(
        _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars")),
        [F.desc("chars"), F.col("doc_id")],
    )
    return ranked.select(
        "doc_id",
        "chars",
        F.floor((F.col("row_number") - 1) / 32).cast("long").alias("batch"),
        ((F.col("row_number") - 1) % 32).cast("long").alias("place"),
    )


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample of 50 documents of 50 to 5,000 characters by an arithmetic hash of the id."""
    h = (F.col("doc_id") * 2654435761 + 97) % 1000003
    d = _docs(spark, sf_dir).where(F.length("text").between(50, 5000)).select("doc_id", "source", h.alias("draw"))
    return d.orderBy("draw", "doc_id").limit(50)


#: Stand-in for the hand-made part of the lexicon.
MANUAL = ["the", "and", "de", "der", "la"]


def lexicon_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon of words tagged with their successor; words before a longer one count as tagged."""
    said = _docs(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"))
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = said.select(
        "doc_id",
        F.posexplode(F.arrays_zip(F.slice("w", F.lit(1), rest).alias("dev"), F.slice("w", F.lit(2), rest).alias("eng"))).alias("i", "p"),
    )
    tagged = pairs.where("length(p.eng) > length(p.dev)").select("p.dev", "p.eng", F.struct("doc_id", "i").alias("at"))
    return lexicon.mine(tagged, said.select(F.explode("w").alias("word")), MANUAL)


def identity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels compared by copy group: how many texts, flags and both are equal to the group's first."""
    d = _docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    j = d.join(labels, "doc_id")
    first = j.groupBy("sha").agg(
        F.min_by(F.struct("quality", "toxic", "lang"), "doc_id").alias("first"),
        F.count("*").alias("copies"),
        F.array_sort(F.collect_set("quality")).alias("seen"),
    )
    same = j.join(first, "sha")
    return same.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("copies") > 1).alias("copied"),
        F.count_if(F.col("quality") == F.col("first.quality")).alias("same_quality"),
        F.count_if(
            (F.col("quality") == F.col("first.quality")) & (F.col("toxic") == F.col("first.toxic")) & (F.col("lang") == F.col("first.lang"))
        ).alias("same_all"),
        F.count_if(F.size("seen") > 1).alias("mixed"),
    )


_PUNCT_SQL = tx.PUNCTUATION.replace("'", "''")


def _norm_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '{_PUNCT_SQL}', ' ', 'g')), '\\s+', ' ', 'g'))"


def _collapse_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def _clock_sql(ms: str) -> str:
    t = f"round_even({ms} / 1000.0::DOUBLE, 0)::BIGINT"
    return f"(CASE WHEN {t} >= 3600 THEN ({t} // 3600)::VARCHAR || ':' ELSE '' END || lpad(({t} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({t} % 60)::VARCHAR, 2, '0'))"


def _srt_sql(ms: str) -> str:
    return f"(lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 60000 // 1000)::VARCHAR, 2, '0') || ',' || lpad(({ms} % 1000)::VARCHAR, 3, '0'))"


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_TOKENS_SQL = "regexp_extract_all(" + _norm_sql("text") + f", '{tx.WORD}')"
_CONTENT_SQL = f"list_filter({_TOKENS_SQL}, lambda t: length(t) >= 3 AND NOT list_contains({_STOP_SQL}, t))"
_WORDS_SQL = f"CASE WHEN {_norm_sql('text')} = '' THEN []::VARCHAR[] ELSE string_split({_norm_sql('text')}, ' ') END"
_SCRIPT_COUNTS = "[" + ", ".join(f"{{'n': len(regexp_extract_all(text, '{b}')), 'o': -{k}, 's': '{n}'}}" for k, (n, b) in enumerate(tx.SCRIPTS)) + "]"
_SAMPLE_SQL = ", ".join(f"({k}, '{t}')" for k, t in _SAMPLES)
_SCORED_SQL = f"""WITH s AS (SELECT conv_id, turn, role, {_WORDS_SQL} AS w FROM conversations),
n AS (SELECT conv_id, turn, role, len(w) AS n, array_to_string(w, '') AS c FROM s),
scored AS (SELECT conv_id, turn, role, (n // 7 + n // 5 - n // 35)::BIGINT AS word_edits, n AS words, (length(c) - length(replace(c, 'e', '')))::BIGINT AS char_edits, length(c) AS chars FROM n)
"""

QUERIES = {
    f.__name__: f for f in (
        line_records,
        normalise_text,
        content_tokens,
        script_detect,
        tag_clean,
        bench_normalise,
        token_estimate,
        render_transcript,
        render_srt,
        romanise_words,
        romaniser_accuracy,
        code_switch_parse,
        language_lookup,
        word_error_rate,
        corpus_rate,
        text_helpers,
        recording_utterances,
        unit_rejoin,
        keyword_grounding,
        keyword_f1,
        json_reply_parse,
        batch_plan,
        seeded_sample,
        lexicon_mining,
        identity_counts,
    )
}
_CATALOGUE_SQL = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in languages.CATALOGUE)
ORACLES = {
    "line_records": _CLOCK + f"SELECT conv_id, turn + 1 AS line_id, coalesce(role, 'Speaker_?') AS speaker, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, {_clock_sql('start_ms')} AS \"from\", {_clock_sql('end_ms')} AS \"to\", trim(text) AS text FROM lines WHERE {_norm_sql('text')} <> ''",
    "normalise_text": f"WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'apart', doc_id, replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)) FROM documents UNION ALL SELECT 'line', conv_id * 1000 + turn, text FROM conversations), n AS (SELECT kind, id, nfc_normalize(text) AS text FROM t) SELECT kind, id, {_norm_sql('text')} AS form FROM n",
    "content_tokens": f"WITH d AS (SELECT doc_id, {_TOKENS_SQL} AS t, {_CONTENT_SQL} AS c FROM documents) SELECT doc_id, len(t) AS n_tokens, len(c) AS n_content, len(list_distinct(c)) AS n_distinct, len(list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1])) AS n_without_repeats FROM d",
    "script_detect": f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_SAMPLE_SQL}) v(doc_id, text)), c AS (SELECT doc_id, list_max({_SCRIPT_COUNTS}) AS b FROM d) SELECT doc_id, CASE WHEN b.n > 0 THEN b.s END AS script FROM c",
    "tag_clean": "SELECT page_id, " + _collapse_sql(f"regexp_replace(coalesce(html, ''), '{tx.TAGS}', ' ', 'g')") + " AS clean FROM pages",
    "bench_normalise": "SELECT doc_id, " + _collapse_sql(
        r"regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\p{P}\p{S}]', ' ', 'g')"
    ) + " AS bench, length(regexp_replace(replace(replace(replace(lower(text), 'colour', 'color'), 'litre', 'liter'), 'metre', 'meter'), '[^a-z]', '', 'g')) AS english_letters FROM documents",
    "token_estimate": _CLOCK + f", n AS (SELECT *, len(regexp_extract_all(text, '{tx.INDIC}')) AS indic FROM lines) SELECT conv_id, turn, (floor((indic / 2 + (length(text) - indic) / 3) * 1.1::DOUBLE) + 1)::BIGINT AS tokens, 2 * length(text) + 30 AS longest, (turn + 1)::VARCHAR || ' | ' || role || ' | ' || {_clock_sql('start_ms')} || '-' || {_clock_sql('end_ms')} || ' | ' || text AS prompt FROM n",
    "render_transcript": _CLOCK + f"SELECT conv_id, string_agg('[' || {_clock_sql('start_ms')} || ' - ' || {_clock_sql('end_ms')} || '] ' || role || ': ' || text, chr(10) ORDER BY start_ms, turn) AS transcript FROM lines WHERE trim(text) <> '' GROUP BY conv_id",
    "render_srt": _CLOCK + f", n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, turn) AS number FROM lines) SELECT conv_id, number, number::VARCHAR || chr(10) || {_srt_sql('start_ms')} || ' --> ' || {_srt_sql('end_ms')} || chr(10) || role || ': ' || text AS entry FROM n WHERE trim(text) <> ''",
    "romanise_words": "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{e}')" for w, e in _WORDS) + ") v(word, latin)",
    "romaniser_accuracy": f"SELECT {len(_WORDS)}::BIGINT AS n, 1.0::DOUBLE AS accuracy",
    "code_switch_parse": "SELECT * FROM (VALUES ('a', 'स्मार्ट फोन', 'smart'), ('b', 'बहुत अच्छा', ''), ('c', 'हाँ ठीक है', ''), ('d', 'plain words', '')) v(key, text, first_english)",
    "language_lookup": f"""WITH cat AS (SELECT * FROM (VALUES {_CATALOGUE_SQL}) v(code, name, script, latin_name, has_ctc)), al AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{c}')" for a, c in languages.ALIASES.items())}) v(alias, code)),
asked AS (SELECT * FROM (VALUES {", ".join(f"('{a}')" for (a,) in _NAMES)}) v(asked)),
k AS (SELECT asked, CASE WHEN trim(asked) = '' THEN 'hi' ELSE coalesce((SELECT c.code FROM cat c WHERE lower(trim(asked)) IN (c.code, lower(c.name))), (SELECT al.code FROM al WHERE alias = lower(trim(asked)))) END AS code FROM asked)
SELECT asked, k.code, name, script, latin_name, has_ctc FROM k LEFT JOIN cat ON k.code = cat.code""",
    "word_error_rate": _SCORED_SQL + "SELECT *, word_edits * 1000000 // greatest(words, 1) AS wer_ppm, char_edits * 1000000 // greatest(chars, 1) AS cer_ppm FROM scored",
    "corpus_rate": _SCORED_SQL + "SELECT role, sum(word_edits)::BIGINT AS edits, sum(words)::BIGINT AS words, round(sum(word_edits) / greatest(sum(words), 1), 6) AS pooled, round(avg(char_edits / greatest(chars, 1)), 6) AS mean_cer FROM scored GROUP BY role",
    "text_helpers": "WITH b AS (SELECT conv_id, turn, text, regexp_replace(trim(text), '\\.+$', '') AS body FROM conversations) SELECT conv_id, turn, CASE WHEN body = '' THEN '' ELSE upper(body[1]) || body[2:] || '.' END AS sentence, replace(replace(text, '|', '\\|'), chr(10), ' ') AS cell, " + _collapse_sql(
        "text"
    ) + " AS collapsed FROM b",
    "recording_utterances": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, turn, length(text) AS chars FROM conversations WHERE " + _collapse_sql(
        f"regexp_replace(text, '{tx.TAGS}', ' ', 'g')"
    ) + " <> ''",
    "unit_rejoin": "WITH p AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS t, generate_subscripts(string_split(text, '.'), 1) AS i FROM conversations), q AS (SELECT conv_id, turn, i, " + _collapse_sql(
        "t"
    ) + " AS t FROM p), j AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY i) AS text, count(*) AS pieces FROM q WHERE t <> '' GROUP BY ALL) SELECT c.conv_id, c.turn, coalesce(j.text, '') AS text, coalesce(pieces, 0) AS pieces FROM conversations c LEFT JOIN j USING (conv_id, turn)",
    "keyword_grounding": f"WITH said AS (SELECT DISTINCT unnest({_CONTENT_SQL}) AS word FROM documents), i AS (SELECT item_id, unnest(list_distinct({_CONTENT_SQL})) AS word FROM benchmark) SELECT item_id, count(*) AS words, count(said.word) AS grounded, count(*) = count(said.word) AS all_grounded FROM i LEFT JOIN said USING (word) GROUP BY item_id",
    "keyword_f1": f"WITH b AS (SELECT item_id, list_distinct({_CONTENT_SQL}) AS b FROM benchmark), a AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, list_distinct({_CONTENT_SQL}) AS a FROM documents), x AS (SELECT *, len(list_intersect(a, b)) AS shared FROM a JOIN b USING (item_id)) SELECT doc_id, item_id, shared, CASE WHEN len(a) + len(b) = 0 THEN 1000000 ELSE 2 * shared * 1000000 // (len(a) + len(b)) END AS f1_ppm, shared = len(a) AS contained FROM x",
    "json_reply_parse": "SELECT event_id, (props->>'$.k')::BIGINT AS value FROM events",
    "batch_plan": "WITH r AS (SELECT doc_id, length(text) AS chars, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS r FROM documents) SELECT doc_id, chars, r // 32 AS batch, r % 32 AS place FROM r",
    "seeded_sample": "SELECT doc_id, source, (doc_id * 2654435761 + 97) % 1000003 AS draw FROM documents WHERE length(text) BETWEEN 50 AND 5000 ORDER BY draw, doc_id LIMIT 50",
    "lexicon_mining": f"""WITH t AS (SELECT doc_id, {_norm_sql("text")} AS t FROM documents), d AS (SELECT doc_id, string_split(t, ' ') AS w FROM t WHERE t <> ''),
e AS (SELECT doc_id, unnest(w) AS dev, generate_subscripts(w, 1) AS i FROM d), o AS (SELECT doc_id, i, dev, lead(dev) OVER (PARTITION BY doc_id ORDER BY i) AS eng FROM e),
c AS (SELECT dev, count(*) AS seen FROM o GROUP BY dev), f AS (SELECT dev FROM c ORDER BY seen DESC, dev LIMIT 2500),
p AS (SELECT dev, eng, count(*) AS n, min((doc_id, i)) AS first FROM o WHERE length(eng) > length(dev) GROUP BY ALL),
b AS (SELECT dev, sum(n)::BIGINT AS total, arg_min(eng, (-n, first)) AS eng, max(n) AS n FROM p GROUP BY dev),
m(dev) AS (VALUES {", ".join(f"('{w}')" for w in MANUAL)})
SELECT dev, eng, total, n FROM b JOIN c USING (dev) ANTI JOIN m USING (dev) ANTI JOIN (SELECT dev FROM f ANTI JOIN m USING (dev)) g USING (dev)
WHERE total >= 2 AND n >= 0.7::DOUBLE * total AND total >= 0.5::DOUBLE * seen""",
    "identity_counts": """WITH j AS (SELECT doc_id, sha256(text) AS sha, lang, quality, toxic FROM documents JOIN labels USING (doc_id)),
g AS (SELECT *, first_value(quality) OVER w AS q, first_value(toxic) OVER w AS t, first_value(lang) OVER w AS l, count(*) OVER (PARTITION BY sha) AS copies, min(quality) OVER (PARTITION BY sha) <> max(quality) OVER (PARTITION BY sha) AS mixed FROM j WINDOW w AS (PARTITION BY sha ORDER BY doc_id))
SELECT count(*) AS n, count(*) FILTER (copies > 1) AS copied, count(*) FILTER (quality = q) AS same_quality, count(*) FILTER (quality = q AND toxic = t AND lang = l) AS same_all, count(*) FILTER (mixed) AS mixed FROM g""",
}
