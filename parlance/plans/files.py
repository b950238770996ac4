"""Queries that write what the writers write and read it back with the readers."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from parlance.functions import signals, text as tx, translation, transliterate
from parlance.operators import reports
from parlance.plans.conversations import _CLOCK, clocked_lines
from parlance.plans.texts import _clock_sql, _collapse_sql
from parlance.plans.timelines import TURNS, turns
from parlance.plans.vectors import _DUO, _dot, _duo
from parlance.runtime import shared_folder, ship_package
from parlance.sources import models, readers, writers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/parlance/files-{uuid.uuid4().hex}/{name}"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in seconds."""
    return turns(spark, sf_dir).select("rec_id", "speaker", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))


def rttm_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as RTTM and read again."""
    path = _folder(spark, "rttm")
    writers.rttm_lines(_timed(spark, sf_dir)).write.text(path)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return readers.read_rttm(spark, path).select("rec_id", "speaker", ms("start"), ms("end"))


#: Documents of a file.
_PER_FILE = 256


def _documents(docs: DataFrame, key: str, path: str) -> None:
    """JSON arrays of documents, of about ``_PER_FILE`` in each file."""
    dealt = docs.withColumn("_file", F.pmod(F.xxhash64(key), F.lit(max(8, docs.count() // _PER_FILE))))
    per = dealt.groupBy("_file").agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("value"))
    per.repartition("_file").write.partitionBy("_file").text(path)


def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcript documents and read as numbered lines."""
    path = _folder(spark, "transcripts")
    lines = clocked_lines(spark, sf_dir)
    said = F.struct("turn", F.col("role").alias("speaker"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
    docs = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("lines"), (F.max("end_ms") / 1000).alias("duration_s"))
    _documents(docs.select(F.col("conv_id").cast("string").alias("order"), "duration_s", "lines"), "order", path)
    read = readers.read_transcripts(spark, path)
    return read.select(F.col("order").cast("long").alias("conv_id"), "duration_s", "line_id", "speaker", "start", "end", "text", "language")


def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity written as reference documents and read as stretches."""
    path = _folder(spark, "references")
    t = _timed(spark, sf_dir)
    docs = t.groupBy("rec_id").agg(F.max("end").alias("duration_s"), F.collect_list(F.struct("start", "end", "speaker")).alias("activity"))
    _documents(docs, "rec_id", path)
    return readers.read_references(spark, path).select("duration_s", "speaker", "start", "end")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines and read with a schema."""
    path = _folder(spark, "lines")
    _table(spark, sf_dir, "conversations").write.json(path)
    return readers.read_json_lines(spark, path, "conv_id long, turn long, role string, text string")


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a result table and read again; missing numbers stay missing."""
    path = _folder(spark, "csv")
    c = _table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal").cast("double")).alias("balance"),
    )
    writers.write_table(c, path)
    return readers.read_facts(spark, path, "c_custkey long, c_mktsegment string, balance double")


def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a lexicon with comments and read as words."""
    path = _folder(spark, "lexicon")
    n = _table(spark, sf_dir, "nation").select(F.concat_ws("\t", "n_name", F.lower("n_name")).alias("value"))
    n.unionByName(n.select(F.concat(F.lit("# "), "value").alias("value"))).write.text(path)
    return readers.read_lexicon(spark, path)


def beat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as points of an annotation layer of each day and read as beats."""
    path = _folder(spark, "layers")
    t = turns(spark, sf_dir).select(
        F.substring("rec_id", 1, 10).alias("day"),
        F.col("start"),
        F.expr("start div 3600000").alias("cycle"),
        (F.expr("start div 60000") % 8 + 1).alias("beat"),
    )
    point = F.format_string('<point frame="%d" label="%d.%d" />', "start", "cycle", "beat")
    layer = t.groupBy("day").agg(
        F.concat(F.lit('<model sampleRate="1000">'), F.array_join(F.collect_list(point), ""), F.lit("</model>")).alias("value")
    )
    layer.repartition("day").write.partitionBy("day").text(path)
    return readers.read_beats(spark, path).select(F.regexp_extract("file", r"day=([0-9-]+)", 1).alias("day"), "cycle", "beat", "t")


def speech_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with their recording and chunk from file names; names without a chunk are recordings of their own."""
    path = _folder(spark, "speech")
    c = _table(spark, sf_dir, "conversations")
    name = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("single"), F.col("conv_id").cast("string"))).otherwise(
        F.format_string("rec%d_chunk_%d.wav", "conv_id", "turn")
    )
    none = F.lit(None).cast("string")
    audio = F.struct(F.lit(None).cast("binary").alias("bytes"), name.alias("path"))
    c.select(
        "text",
        F.length("text").cast("double").alias("duration"),
        F.col("role").alias("speaker_id"),
        *(none.alias(x) for x in ("scenario", "task_name", "gender", "district")),
        audio.alias("audio_filepath"),
    ).write.parquet(path)
    return readers.read_chunked_speech(spark, path).select("recording", "chunk", "speaker_id", "text", "duration")


def field_speech_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field recordings, whose flag comes in several spellings."""
    path = _folder(spark, "field")
    flag = F.element_at(F.array(*(F.lit(x) for x in ("Yes", "TRUE", "no", "1", "0"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = _table(spark, sf_dir, "events").select(
        F.col("value").alias("duration"),
        F.col("event_id").alias("speakerID"),
        F.lit("f").alias("gender"),
        F.col("event_type").alias("district"),
        flag.alias("isTranscriptionAvailable"),
    )
    e.write.parquet(path)
    return readers.read_field_speech(spark, path).select("speakerID", "district", "transcribed")


def transcribed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with notes in braces as spoken words and English spellings."""
    path = _folder(spark, "transcribed")
    note = F.format_string("t%d {en%d} end.", "turn", "conv_id")
    _table(spark, sf_dir, "conversations").select(
        note.alias("transcript"),
        F.lit("f").alias("gender"),
        F.col("role").alias("district"),
    ).write.parquet(path)
    return readers.read_transcribed_field_speech(spark, path).select("district", "text", F.try_element_at("english", F.lit(0)).alias("first_english"))


def picked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 orders of a repeatable draw with their wide columns, in the order of the draw."""
    o = _table(spark, sf_dir, "orders")
    draw = (F.col("o_orderkey") * 2654435761 + 11) % 1000003
    picks = o.select("o_orderkey", draw.alias("place")).orderBy("place", "o_orderkey").limit(40)
    return readers.take_rows(o.select("o_orderkey", "o_custkey", "o_totalprice"), picks, "o_orderkey")


def noise_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of two categories from the folds of each split."""
    meta = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), (F.col("user_id") % 5 + 1).alias("fold"))
    each = [readers.noise_events(meta, ["click", "view"], s).withColumn("split", F.lit(s)) for s in ("dev", "test")]
    return each[0].unionByName(each[1])


def timeline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of each recording as a JSON document; times are whole hundredths."""
    t = turns(spark, sf_dir)
    return writers.timeline_json(t.select("rec_id", "speaker", *((F.expr(f"{c} div 10") / 100).alias(c) for c in ("start", "end"))))


def result_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and lines written as a bundle partitioned by recording, and counted in it."""
    path = _folder(spark, "bundle")
    # Turns are told long by their whole milliseconds: a difference of seconds is not exact.
    long = F.col("end") - F.col("start") > 600_000
    seconds = [(F.col(c) / 1000).alias(c) for c in ("start", "end")]
    t = turns(spark, sf_dir).select(F.substring("rec_id", 1, 10).alias("rec_id"), "speaker", *seconds, long.alias("long"))
    writers.write_bundle({"turns": t.drop("long"), "long": t.where("long").drop("long")}, path)
    parts = [
        spark.read.parquet(f"{path}/{kind}").withColumn("rec_id", F.col("rec_id").cast("string")).groupBy("rec_id").agg(
            F.count("*").alias("n"),
            F.count_distinct("speaker").alias("speakers"),
        ).withColumn("kind", F.lit(kind)) for kind in ("turns", "long")
    ]
    return parts[0].unionByName(parts[1])


@F.pandas_udf(BinaryType())
def _encoded(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: writers.wav_bytes(signals.peak_normalised(np.asarray(x, float))[0]))


def sound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as signals of a peak of 0.9, encoded as sound files and decoded again: length and first sample."""
    ship_package(spark)
    e = _table(spark, sf_dir, "embeddings").select("vec_id", signals.decoded(_encoded("embedding")).alias("x"))
    return e.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.get("x", F.lit(0)).cast("double"), 4).alias("first"))


def mixture_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains with which leaking estimates of a pair add up to its mixture."""
    ship_package(spark)

    def run(frames):
        for frame in frames:
            gains = [signals.mixture_gains(np.stack([r.e0, r.e1]), r.mix) for r in frame.itertuples()]
            yield pd.DataFrame({"pair": frame["pair"], "g0": [round(float(g[0]), 6) for g in gains], "g1": [round(float(g[1]), 6) for g in gains]})

    return _duo(spark, sf_dir).select("pair", "e0", "e1", "mix").mapInPandas(run, "pair long, g0 double, g1 double")


def transcript_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each conversation's lines, whose times are whole seconds."""
    lines = clocked_lines(spark, sf_dir).select(
        "conv_id",
        F.col("turn").alias("line_id"),
        F.col("role").alias("speaker"),
        F.floor(F.col("start_ms") / 1000).alias("start"),
        F.floor(F.col("end_ms") / 1000).alias("end"),
        F.length("text").cast("string").alias("text"),
    )
    return reports.fingerprint(lines, "conv_id")


def plain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as old relative paths, rewritten."""
    p = _table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.when(F.col("page_id") % 2 == 0, "data\\").otherwise("old/data/"), F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"),
    )
    return p.select("page_id", readers.rewrite_path(F.col("path")).alias("path"))


#: Texts, and what a translator gets of them.
_PROTECTED = [
    ("Mail a@b.com, see www.x.org/p?q=1 !", "Mail <ID1>, see <ID2>!", "a@b.com www.x.org/p?q=1"),
    ("It cost 12,500 ( or 30% ) : ok", "It cost <ID1> (or <ID2>):ok", "12,500 30%"),
    ("plain  words", "plain words", ""),
]


def translation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their addresses, links and figures hidden, and put back again."""
    ship_package(spark)
    asked = spark.createDataFrame([t for t, *_ in _PROTECTED], "string").select(
        F.col("value").alias("asked"),
        translation.protected("value").alias("p"),
    )
    back = asked.select(
        "asked",
        "p.text",
        F.array_join("p.parts", " ").alias("parts"),
        translation.restored(F.col("p.text"), F.col("p.parts")).alias("back"),
    )
    return back.select("asked", "text", "parts", "back")


def clip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of up to a second, transcribed by the stand-in that says their length; those below a tenth stay empty."""
    ship_package(spark)

    def run(frames):
        for frame in frames:
            clips = [np.zeros(int(n), np.float32) for n in frame["n"]]
            yield frame[["s_suppkey"]].assign(text=models.transcribe(clips, models.DurationRecogniser()))

    clips = _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("long").alias("s_suppkey"),
        (F.col("s_suppkey") * 613 % 16_000).alias("n"),
    )
    return clips.mapInPandas(run, "s_suppkey long, text string")


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small reports as JSON documents; what is missing stays out."""
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("lines"), F.min("role").alias("title"))
    return writers.report_json(
        c.select("conv_id", "title", F.when(F.col("lines") > 4, F.col("lines")).alias("lines"), F.array("title").alias("keywords"))
    )


_FOLDED = [("ज़मीन", "जमीन"), ("हाँ", "हां"), ("क‍ष", "कष"), ("plain", "plain"), ("é", "é")]


def folded_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without the marks by which spellings of one word differ."""
    ship_package(spark)
    return spark.createDataFrame([w for w, _ in _FOLDED], "string").select(
        F.col("value").alias("word"),
        transliterate.fold_variants("value").alias("folded"),
    )


QUERIES = {
    f.__name__: f for f in (
        rttm_files,
        transcript_files,
        reference_files,
        json_lines,
        csv_tables,
        lexicon_files,
        beat_files,
        speech_scan,
        field_speech_scan,
        transcribed_scan,
        picked_rows,
        noise_clips,
        timeline_documents,
        result_bundle,
        sound_files,
        mixture_gains,
        transcript_fingerprints,
        plain_paths,
        folded_spellings,
        translation_parts,
        clip_texts,
        report_documents,
    )
}
_TAGLESS = _collapse_sql(f"regexp_replace(coalesce(text, ''), '{tx.TAGS}', ' ', 'g')")
ORACLES = {
    "rttm_files": TURNS + "SELECT rec_id, speaker, s AS start_ms, e AS end_ms FROM turns",
    "transcript_files": _CLOCK + "SELECT conv_id, max(end_ms) OVER (PARTITION BY conv_id) / 1000.0::DOUBLE AS duration_s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_id, coalesce(role, 'Speaker_?') AS speaker, start_ms / 1000.0::DOUBLE AS \"start\", end_ms / 1000.0::DOUBLE AS \"end\", trim(text) AS text, 'hi' AS language FROM lines",
    "reference_files": TURNS + 'SELECT max(e) OVER (PARTITION BY rec_id) / 1000.0::DOUBLE AS duration_s, speaker, s / 1000.0::DOUBLE AS "start", e / 1000.0::DOUBLE AS "end" FROM turns',
    "json_lines": "SELECT conv_id, turn, role, text FROM conversations",
    "csv_tables": "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal::DOUBLE END AS balance FROM customer",
    "lexicon_files": "SELECT n_name AS word, lower(n_name) AS latin FROM nation",
    "beat_files": TURNS + "SELECT substr(rec_id, 1, 10) AS day, (s // 3600000)::INT AS cycle, (s // 60000 % 8 + 1)::INT AS beat, s / 1000.0::DOUBLE AS t FROM turns",
    "speech_scan": f"SELECT CASE WHEN turn % 5 = 0 THEN 'single' || conv_id ELSE 'rec' || conv_id END AS recording, (CASE WHEN turn % 5 = 0 THEN 0 ELSE turn END)::INT AS chunk, role AS speaker_id, {_TAGLESS} AS text, length(text)::DOUBLE AS duration FROM conversations",
    "field_speech_scan": "SELECT event_id AS speakerID, event_type AS district, event_id % 5 IN (0, 1, 3) AS transcribed FROM events",
    "transcribed_scan": "SELECT role AS district, 't' || turn || ' end' AS text, 'en' || conv_id AS first_english FROM conversations",
    "picked_rows": "SELECT o_orderkey, (o_orderkey * 2654435761 + 11) % 1000003 AS place, o_custkey, o_totalprice FROM orders ORDER BY place, o_orderkey LIMIT 40",
    "noise_clips": "SELECT event_id, event_type AS category, user_id % 5 + 1 AS fold, CASE WHEN user_id % 5 >= 3 THEN 'dev' ELSE 'test' END AS split FROM events WHERE event_type IN ('click', 'view')",
    "timeline_documents": TURNS.replace("WITH turns", "WITH exact") + f""", turns AS (SELECT rec_id, speaker, s // 10 * 10 AS s, e // 10 * 10 AS e FROM exact)
SELECT rec_id, to_json(list({{'start': {_clock_sql("s")}, 'end': {_clock_sql("e")}, 'start_s': s / 1000.0::DOUBLE, 'end_s': e / 1000.0::DOUBLE, 'speaker': speaker}} ORDER BY s, {_clock_sql("s")}, {_clock_sql("e")}, e, speaker))::VARCHAR AS json FROM turns GROUP BY rec_id""",
    "result_bundle": TURNS + ", t AS (SELECT substr(rec_id, 1, 10) AS rec_id, speaker, e - s AS size FROM turns) SELECT rec_id, count(*) AS n, count(DISTINCT speaker) AS speakers, 'turns' AS kind FROM t GROUP BY rec_id UNION ALL SELECT rec_id, count(*), count(DISTINCT speaker), 'long' FROM t WHERE size > 600000 GROUP BY rec_id",
    "sound_files": "WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, len(x) AS n, round(round_even(x[1] * 0.9::DOUBLE / list_max(list_transform(x, lambda v: abs(v))) * 32767, 0) / 32768, 4) AS first FROM w",
    "mixture_gains": _DUO + f", d AS (SELECT pair, {_dot('e0', 'e0')} AS xx, {_dot('e1', 'e1')} AS yy, {_dot('e0', 'e1')} AS xy, {_dot('e0', 'mix')} AS xm, {_dot('e1', 'mix')} AS ym FROM ab), r AS (SELECT *, 0.001::DOUBLE * (xx + yy) / 2 + 1e-12::DOUBLE AS ridge FROM d) SELECT pair, round((xm * (yy + ridge) - ym * xy) / ((xx + ridge) * (yy + ridge) - xy * xy), 6) AS g0, round((ym * (xx + ridge) - xm * xy) / ((xx + ridge) * (yy + ridge) - xy * xy), 6) AS g1 FROM r",
    "transcript_fingerprints": _CLOCK + "SELECT conv_id, sha256(to_json(list({'line_id': turn, 'speaker': role, 'start': start_ms // 1000, 'end': end_ms // 1000, 'text': length(text)::VARCHAR} ORDER BY turn))::VARCHAR) AS sha FROM lines GROUP BY conv_id",
    "plain_paths": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'old/data/' END || url AS path FROM pages",
    "translation_parts": "SELECT * FROM (VALUES " + ", ".join(
        f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in (
            (
                a,
                b,
                c,
                {0: "Mail a@b.com, see www.x.org/p?q=1!", 1: "It cost 12,500 (or 30%):ok", 2: "plain words"}[k],
            ) for k, (a, b, c) in enumerate(_PROTECTED)
        )
    ) + ") v(asked, text, parts, back)",
    "clip_texts": "SELECT s_suppkey::BIGINT AS s_suppkey, CASE WHEN s_suppkey * 613 % 16000 < 1600 THEN '' ELSE printf('%.2f', (s_suppkey * 613 % 16000) / 16000.0::DOUBLE) END AS text FROM supplier",
    "report_documents": "WITH c AS (SELECT conv_id, count(*) AS n, min(role) AS title FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN n > 4 THEN to_json({'title': title, 'lines': n, 'keywords': [title]})::VARCHAR ELSE to_json({'title': title, 'keywords': [title]})::VARCHAR END AS json FROM c",
    "folded_spellings": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _FOLDED) + ") v(word, folded)",
}
