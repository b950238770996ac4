"""Writers of timelines, transcripts, subtitles, annotations and result tables."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text as tx


def timeline_json(turns: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, json): turns of each recording by start, as clock strings and seconds."""
    entry = F.struct(
        F.col("start").alias("start_s"),
        tx.clock(F.col("start")).alias("from"),
        tx.clock(F.col("end")).alias("to"),
        F.round("end", 2).alias("end_s"),
        "speaker",
    )
    ordered = F.array_sort(F.collect_list(entry))
    shown = F.transform(
        ordered,
        lambda x: F.struct(
            x["from"].alias("start"),
            x["to"].alias("end"),
            F.round(x["start_s"], 2).alias("start_s"),
            x["end_s"].alias("end_s"),
            x["speaker"].alias("speaker"),
        ),
    )
    return turns.groupBy(key).agg(F.to_json(shown).alias("json"))


def transcript_text(lines: DataFrame, key: str = "rec_id", text: str = "text") -> DataFrame:
    """(key, text): ``[MM:SS - MM:SS] speaker: text`` lines by start; empty lines are left out."""
    line = F.concat(
        F.lit("["),
        tx.clock(F.col("start")),
        F.lit(" - "),
        tx.clock(F.col("end")),
        F.lit("] "),
        F.col("speaker"),
        F.lit(": "),
        F.col(text),
    )
    ordered = F.array_sort(F.collect_list(F.struct("start", "line_id", line.alias("line"))))
    return lines.where(F.trim(text) != "").groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def subtitles(lines: DataFrame, key: str = "rec_id", text: str = "text", *, renumber: bool = False) -> DataFrame:
    """(key, srt): numbers count all lines unless ``renumber``, so that dropped empty lines leave gaps."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "line_id", "end", "speaker", F.col(text).alias("said"))))
    ms = lambda s: F.round(s * 1000).cast("long")
    entry = lambda x, n: F.concat(
        (n + 1).cast("string"),
        F.lit("\n"),
        tx.srt_time(ms(x["start"])),
        F.lit(" --> "),
        tx.srt_time(ms(x["end"])),
        F.lit("\n"),
        x["speaker"],
        F.lit(": "),
        x["said"],
        F.lit("\n"),
    )
    spoken = lambda xs: F.filter(xs, lambda x: F.trim(x["said"]) != "")
    if renumber:
        entries = F.transform(spoken(ordered), entry)
    else:
        entries = F.array_compact(F.transform(ordered, lambda x, n: F.when(F.trim(x["said"]) != "", entry(x, n))))
    return lines.groupBy(key).agg(F.array_join(entries, "\n").alias("srt"))


def transcript_json(lines: DataFrame, recordings: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, json): order, language, duration, speakers and numbered lines of each recording, as the report stage reads them.

    ``recordings`` has (key, order, language, duration_s), ``lines`` (key,
    line_id, start, end, speaker, text, latin); recordings without lines keep
    empty lists.
    """
    entry = F.struct("start", "line_id", "end", "speaker", "text", "latin")
    per = lines.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    shown = F.transform(
        F.coalesce("lines", F.array().cast(per.schema["lines"].dataType)),
        lambda x: F.struct(
            x["speaker"].alias("speaker"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["text"].alias("text"),
            x["latin"].alias("latin"),
        ),
    )
    speakers = F.array_distinct(F.transform("shown", lambda x: x["speaker"]))
    joined = recordings.join(per, key, "left").withColumn("shown", shown)
    return joined.select(
        key,
        F.to_json(F.struct("order", "language", "duration_s", speakers.alias("speakers"), F.col("shown").alias("lines"))).alias("json"),
    )


def stage3_transcript(systems: DataFrame, references: DataFrame, system: str, romanise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(rec_id, order, line_id, speaker, start, end, text, latin) that the report stage gets for a system.

    The reference's lines by start, romanised, for ``reference``; else the lines
    stored for the system. Only one system separates by turn (order B); all
    others count as oracles.
    """
    columns = ["rec_id", "speaker", "start", "end", "text"]
    if system == "reference":
        by = W.partitionBy("rec_id").orderBy("start", "end", "speaker")
        latin = romanise(F.col("text")) if romanise else F.col("text")
        lines = references.select(*columns, F.row_number().over(by).cast("long").alias("line_id"), latin.alias("latin"))
    else:
        lines = systems.where(F.col("system") == system).select(*columns, "line_id", "latin")
    return lines.select(
        "rec_id",
        F.lit("B" if system == "B-spectral" else "oracle").alias("order"),
        "line_id",
        "speaker",
        "start",
        "end",
        "text",
        "latin",
    )


def live_payload(turns: DataFrame, overlaps: DataFrame, lines: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, payload): turns, overlap regions and non-empty lines of each recording by start, and whether it was separated."""
    listed = lambda df, *c: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*c))).alias("v"))
    said = listed(lines.where(F.trim("text") != ""), "start", "end", "speaker", "text").withColumnRenamed("v", "lines")
    both = listed(overlaps, "start", "end").withColumnRenamed("v", "overlaps")
    per = listed(turns, "start", "end", "speaker").withColumnRenamed("v", "turns").join(both, key, "left").join(said, key, "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(per.schema[c].dataType)).alias(c)
    shown = per.select(key, "turns", empty("overlaps"), empty("lines"))
    return shown.select(key, F.to_json(F.struct("turns", "overlaps", "lines", (F.size("overlaps") > 0).alias("separated"))).alias("payload"))


def report_json(reports: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, json): each report as one JSON document, without fields that are null."""
    return reports.select(key, F.to_json(F.struct(*(c for c in reports.columns if c != key))).alias("json"))


def cached(make: Callable[[], DataFrame], root: str, name: str, version: str, spark: SparkSession) -> DataFrame:
    """The table of a name and version below ``root``: read where it was finished, else made and written.

    The version has to tell everything that the table depends on; a table that
    was not finished (no success mark) is made anew.
    """
    path = f"{root}/{name}/{version}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_conversations(conversations: DataFrame, turns: DataFrame, path: str) -> None:
    """Simulated conversations (id, split, ...) and their turns (id, split, ...), partitioned by split."""
    for name, df in (("conversations", conversations), ("turns", turns)):
        df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/{name}")


def rttm_lines(turns: DataFrame, key: str = "rec_id") -> DataFrame:
    """RTTM text lines of turns, to be written with ``write.text``."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", key, "start", F.col("end") - F.col("start"), "speaker")
    return turns.orderBy(key, "start").select(line.alias("value"))


def write_bundle(result: dict[str, DataFrame], path: str, key: str = "rec_id") -> None:
    """Every part of a result as one Parquet table per kind, partitioned by recording."""
    for kind, df in result.items():
        df.write.mode("overwrite").partitionBy(key).parquet(f"{path}/{kind}")


def markdown_table(df: DataFrame) -> str:
    """A small result table as Markdown; for reports, so it is collected."""
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join('' if v is None else str(v).replace('|', chr(92) + '|') for v in row)} |" for row in df.collect())])


def wav_bytes(samples: np.ndarray, rate: int = 16_000) -> bytes:
    """PCM 16 of one channel, or of a channels-by-samples array; a peak above 0.99 is scaled down for all channels alike."""
    x = np.atleast_2d(np.asarray(samples, float))
    peak = np.abs(x).max() if x.size else 0
    x = x * (0.99 / peak) if peak > 0.99 else x
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(x.T * 32767).astype("<i2").tobytes())
    return out.getvalue()


def median_rows(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The upper median row of each small group: the example to export."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1
    count = F.count("*").over(W.partitionBy(*group))
    return rows.withColumn("_place", place).withColumn("_count", count).where(
        F.col("_place") == F.floor(F.col("_count") / 2)
    ).drop("_place", "_count")
