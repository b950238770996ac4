"""Readers of corpora, annotations and transcripts; every one is lazy and prunes columns."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import languages, text as tx, transliterate
from parlance.runtime import ship_package

TRANSCRIPT = "language string, order string, duration_s double, lines array<struct<speaker: string, start: double, end: double, text: string, latin: string, hinglish: string, audio: string>>"


def data_root(variable: str = "PARLANCE_DATA", pointer: str = "data_location.txt", default: str = "data") -> Path:
    """The data folder: an environment variable, else a pointer file, else the default."""
    if named := os.environ.get(variable):
        return Path(named)
    if Path(pointer).exists() and (named := Path(pointer).read_text(encoding="utf-8").strip()):
        return Path(named)
    return Path(default)


def rewrite_path(path):
    """Column of paths with forward slashes and without an old leading ``data/``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^data/", "")


def shard_pattern(language: str = "hindi", split: str = "valid", shard: int = 0) -> str:
    """Where a corpus keeps a language's shard, as a glob for ``spark.read.parquet``."""
    folder = languages.resolve_language(language)[1].lower()
    return f"{folder}/valid-00000-of-00001.parquet" if split == "valid" else f"{folder}/train-{shard:05d}-of-*.parquet"


def read_chunked_speech(spark: SparkSession, path: str, *, with_audio: bool = False) -> DataFrame:
    """Utterances whose file names tell recording and chunk; the audio bytes are read only on demand."""
    raw = spark.read.parquet(path)
    file = F.col("audio_filepath.path")
    pattern = r"^(.+)_chunk_(\d+)\.\w+$"
    named = F.rlike(file, F.lit(pattern))
    return raw.select(
        tx.clean_tags(F.col("text")).alias("text"), "duration", "speaker_id", "scenario", "task_name", "gender", "district", file.alias("path"),
        F.when(named, F.regexp_extract(file, pattern, 1)).otherwise(file).alias("recording"), F.when(named, F.regexp_extract(file, pattern, 2).cast("int")).otherwise(0).alias("chunk"),
        *([F.col("audio_filepath.bytes").alias("audio_bytes")] if with_audio else []),
    )


def read_field_speech(spark: SparkSession, path: str, *, with_audio: bool = False) -> DataFrame:
    """Field recordings; the transcription flag may be any spelling of a boolean."""
    raw = spark.read.parquet(path)
    flag = F.lower(F.col("isTranscriptionAvailable").cast("string")).isin("yes", "true", "1")
    return raw.select(
        "duration",
        "speakerID",
        "gender",
        "district",
        flag.alias("transcribed"),
        *([F.col("audio.bytes").alias("audio_bytes")] if with_audio else []),
    )


def read_transcribed_field_speech(spark: SparkSession, path: str, *, with_audio: bool = False) -> DataFrame:
    """Field recordings with their spoken words and the English spellings by word index."""
    ship_package(spark)
    raw = spark.read.parquet(path).withColumn("p", transliterate.code_switches(F.coalesce("transcript", F.lit(""))))
    return raw.select(
        "gender",
        "district",
        F.col("p.text").alias("text"),
        F.col("p.english").alias("english"),
        *([F.col("audio.bytes").alias("audio_bytes")] if with_audio else []),
    )


def take_rows(source: DataFrame, picks: DataFrame, key: str, pushed: int = 1000) -> DataFrame:
    """Rows of ``source`` for the picks (key, place), in pick order: metadata is chosen first, wide columns are joined after.

    Up to ``pushed`` keys go into the scan as a filter, so row groups without
    one of them are not read; more picks are a plain join.
    """
    keys = [r[0] for r in picks.select(key).distinct().limit(pushed + 1).collect()]
    few = source.where(F.col(key).isin(keys)) if len(keys) <= pushed else source
    return picks.join(few, key).orderBy("place")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, speaker, start, end) of RTTM lines with eight fields or more."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.size(p) >= 8) & (F.get(p, F.lit(0)) == "SPEAKER"))
    start = F.get(p, F.lit(3)).cast("double")
    return rows.select(
        F.get(p, F.lit(1)).alias("rec_id"),
        F.get(p, F.lit(7)).alias("speaker"),
        start.alias("start"),
        (start + F.get(p, F.lit(4)).cast("double")).alias("end"),
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, language, duration_s, line_id, speaker, start, end, text, latin): numbered lines of transcript documents.

    Numbers count all lines; a document whose ``lines`` is no list of objects
    has none, because the schema is fixed and reading is permissive.
    """
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    each = docs.select("file", "language", "order", "duration_s", F.posexplode("lines").alias("pos", "line"))
    return each.select(
        "file", F.coalesce("language", F.lit("hi")).alias("language"), "order", "duration_s", (F.col("pos") + 1).alias("line_id"), F.coalesce("line.speaker", F.lit("Speaker_?")).alias("speaker"),
        F.coalesce("line.start", F.lit(0.0)).alias("start"), F.coalesce("line.end", F.lit(0.0)).alias("end"), F.trim(F.coalesce("line.text", F.lit(""))).alias("text"), F.trim(F.coalesce("line.latin", "line.hinglish", F.lit(""))).alias("latin"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result tables: CSV with a header and a given schema; empty numbers are null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, latin) of a tab-separated lexicon; blank lines and comments are skipped, words come in NFC."""
    ship_package(spark)
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~F.startswith("value", F.lit("#")))
    p = F.split("value", "\t")
    return rows.select(transliterate.to_nfc(F.trim(F.get(p, F.lit(0)))).alias("word"), F.trim(F.get(p, F.lit(1))).alias("latin"))


def read_beats(spark: SparkSession, path: str) -> DataFrame:
    """(file, cycle, beat, t) of annotation layers: points labelled ``cycle.beat`` at a frame."""
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    rate = F.regexp_extract("value", r'sampleRate="(\d+)"', 1).cast("double")
    point = r'<point frame="(\d+)" label="(\d+)\.(\d+)"'
    parts = [F.regexp_extract_all("value", F.lit(point), F.lit(k)).alias(n) for k, n in ((1, "frame"), (2, "cycle"), (3, "beat"))]
    rows = files.select("file", rate.alias("rate"), *parts).select("file", "rate", F.explode(F.arrays_zip("frame", "cycle", "beat")).alias("p"))
    return rows.select(
        "file",
        F.col("p.cycle").cast("int").alias("cycle"),
        F.col("p.beat").cast("int").alias("beat"),
        (F.col("p.frame").cast("double") / F.col("rate")).alias("t"),
    )


def read_tonics(spark: SparkSession, path: str) -> DataFrame:
    """(singer, tonic_hz) of a YAML file of ``name: number`` lines; comments and nested keys are skipped."""
    pattern = r"^([A-Za-z_][\w-]*)\s*:\s*([0-9.]+)\s*(?:#.*)?$"
    rows = spark.read.text(path).where(F.rlike("value", F.lit(pattern)))
    return rows.select(
        F.lower(F.regexp_extract("value", pattern, 1)).alias("singer"),
        F.regexp_extract("value", pattern, 2).cast("double").alias("tonic_hz"),
    )


def list_recordings(spark: SparkSession, audio: str, annotations: DataFrame, tonics: DataFrame) -> DataFrame:
    """Recordings (path, singer, raga, tonic_hz) named ``varnam-by-S-in-R-raaga`` that have an annotation (singer, raga)."""
    files = spark.read.format("binaryFile").load(audio).select("path")
    pattern = r"varnam-by-([a-z]+)-in-([a-z]+)-raaga"
    named = files.where(F.rlike("path", F.lit(pattern))).select(
        "path",
        F.regexp_extract("path", pattern, 1).alias("singer"),
        F.regexp_extract("path", pattern, 2).alias("raga"),
    )
    return named.join(annotations.select("singer", "raga").distinct(), ["singer", "raga"]).join(F.broadcast(tonics), "singer")


def list_strokes(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(stroke, take, path) of stroke samples; odd takes are for development, even ones for testing."""
    pattern = r"__([a-z]+)-[a-z#]+-(\d+)\.wav$"
    files = spark.read.format("binaryFile").load(path).select(
        "path",
        F.lower(F.replace("path", F.lit("%23"), F.lit("#"))).alias("low"),
    ).where(F.rlike("low", F.lit(pattern)))
    take = F.regexp_extract("low", pattern, 2).cast("int")
    return files.select(F.regexp_extract("low", pattern, 1).alias("stroke"), take.alias("take"), "path").where(
        F.pmod("take", F.lit(2)) == (1 if split == "dev" else 0)
    )


def noise_beds(beds: DataFrame, split: str, samples: str = "samples") -> DataFrame:
    """Beds with the half of their samples that a split may use: the first for development, the second for tests."""
    half = F.floor(F.size(samples) / 2).cast("int")
    part = F.slice(samples, F.lit(1), half) if split == "dev" else F.slice(samples, half + 1, F.size(samples) - half)
    return beds.withColumn(samples, part)


def noise_events(meta: DataFrame, categories: list[str], split: str) -> DataFrame:
    """Clips of the categories from the folds of a split."""
    return meta.where(F.col("category").isin(categories) & F.col("fold").isin([4, 5] if split == "dev" else [1, 2, 3]))


def with_tracks(references: DataFrame, audio: DataFrame) -> DataFrame:
    """References (rec_id, ...) with their mixture and their sources from audio rows (rec_id, name, samples): ``mix`` is the mixture."""
    per = audio.groupBy("rec_id").agg(
        F.first(F.when(F.col("name") == "mix", F.col("samples")), ignorenulls=True).alias("mix"),
        F.map_from_entries(F.collect_list(F.when(F.col("name") != "mix", F.struct("name", "samples")))).alias("sources"),
    )
    return references.join(per, "rec_id")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(file, speaker, start, end) of the spoken stretches of reference documents."""
    docs = spark.read.schema(
        "duration_s double, speakers array<string>, activity array<struct<start: double, end: double, speaker: string>>"
    ).option("multiLine", True).json(path)
    return docs.withColumn("file", F.input_file_name()).select("file", "duration_s", F.inline("activity"))
