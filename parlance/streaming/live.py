"""Live mode: streams of turns whose results are kept current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
FIRST_PASS = "3 seconds"
REFRESH = "1500 milliseconds"


def event_stream(spark: SparkSession, pattern: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as they arrive in files, with the settle rule of three seconds as the watermark."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return raw.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", FIRST_PASS)


def talk_time(events: DataFrame) -> DataFrame:
    """Turns and talk time of each speaker per day: incremental state is one row per speaker and day."""
    group = (F.col("user_id") % 8).cast("string")
    speaker = F.concat(F.lit("S"), F.expr("(user_id div 8) % 3").cast("string"))
    talk = F.sum(F.floor(F.col("value") * 20000).cast("long"))
    per = events.groupBy(F.window("at", "1 day").alias("w"), group.alias("grp"), speaker.alias("speaker")).agg(
        F.count("*").alias("turns"),
        talk.alias("talk_ms"),
    )
    return per.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "grp", "speaker", "turns", "talk_ms")


def activity(events: DataFrame) -> DataFrame:
    """Sliding activity: turns per 1.5-hour window every 45 minutes."""
    return events.groupBy(F.window("at", "90 minutes", "45 minutes").alias("w"), "event_type").agg(F.count("*").alias("turns")).select(
        F.col("w.start").alias("start"),
        "event_type",
        "turns",
    )


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Sessions of a user: the streaming form of turns merged by a gap."""
    return events.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("turns")).select(
        "user_id",
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        "turns",
    )


def settled(events: DataFrame) -> DataFrame:
    """Sessions that are final: in append mode one comes out once the watermark has passed its end, and its state goes."""
    return sessions(events)


def new_texts(lines: DataFrame) -> DataFrame:
    """Lines (at, lang, text) whose text is new within the watermark: what a translator has to be asked."""
    return lines.dropDuplicatesWithinWatermark(["lang", "text"])


def versioned(
    result: DataFrame,
    path: str,
    checkpoint: str,
    *,
    everything: bool = True,
    take: Callable[[], str] | None = None,
    ready: Callable[[DataFrame], bool] | None = None,
) -> StreamingQuery:
    """Write every pass under its version; ``everything`` ends after all that is there, else passes go on.

    The checkpoint carries offsets and state, so a restarted query goes on where
    the last one stopped and a repeated pass overwrites its own version. A pass
    is dropped where ``take`` names another take than at the start, and while
    ``ready`` finds too little in it. Complete mode keeps all groups: the state
    is as large as the result, whatever the watermark.
    """
    begun = take() if take else None

    def write(batch: DataFrame, version: int) -> None:
        # Also a pass that is dropped has to be computed, as its state goes on.
        if take and take() != begun:
            batch.write.format("noop").mode("overwrite").save()
            return
        held = batch.persist()
        if ready is None or ready(held):
            held.write.mode("overwrite").parquet(f"{path}/version={version}")
        held.unpersist()

    writer = result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if everything else writer.trigger(processingTime=REFRESH)).start()


def enough(least_ms: int = 3000) -> Callable[[DataFrame], bool]:
    """Whether a pass holds as much talk as the first one needs."""
    return lambda batch: (batch.agg(F.sum("talk_ms")).first()[0] or 0) >= least_ms


def envelope_since(bins: DataFrame, offset: int) -> DataFrame:
    """(bin, peak) from a bin on: what a page that has seen all before still needs; the last one seen may have grown."""
    return bins.where(F.col("bin") >= max(0, offset - 1)).orderBy("bin")


def bounded(query: StreamingQuery, most_seconds: float) -> None:
    """Let a session run for so long at most, then end it after the pass that is on."""
    if not query.awaitTermination(most_seconds):
        query.stop()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a versioned result."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == newest).drop("version")
