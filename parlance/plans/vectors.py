"""Queries over fingerprint windows: ``embeddings``, fifty windows to a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import clustering as cl, diarize as dz
from parlance.operators.separation import output_table, si_sdr
from parlance.runtime import ship_package

SIZE = 50


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, win_idx, label, emb as doubles)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.floor(F.col("vec_id") / SIZE).cast("long").alias("rec"),
        F.col("vec_id").alias("win_idx"),
        "label",
        F.col("embedding").cast("array<double>").alias("emb"),
    )


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar windows (itself included) of each window in its recording."""
    ship_package(spark)
    return cl.nearest_windows(windows(spark, sf_dir), "rec", "win_idx", 10).drop("sim")


def affinity_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenth percentile of the pair similarities of each recording and whether it passes as one speaker."""
    ship_package(spark)
    p = cl.similarity_percentile(windows(spark, sf_dir), "rec", "win_idx", 0.1)
    return p.select("rec", F.round("value", 6).alias("p10"), (F.col("value") > 0.55).alias("one_speaker"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, length and first value of each label's mean fingerprint."""
    c = cl.centroids(windows(spark, sf_dir).withColumn("emb", cl.normalised(F.col("emb"))), ["label"], "emb")
    return c.select(
        "label",
        "n",
        F.round(F.sqrt(cl.dot(F.col("centroid"), F.col("centroid"))), 6).alias("length"),
        F.round(F.get("centroid", F.lit(0)), 6).alias("first_value"),
    )


def relabel_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels numbered by first appearance in each recording, with speaker names."""
    r = cl.relabel_first_seen(windows(spark, sf_dir).select("rec", "win_idx", "label"), ["rec"], "win_idx", "label")
    name = F.when(F.col("dense") < 26, F.concat(F.lit("Speaker_"), F.char(65 + F.col("dense")))).otherwise(
        F.concat(F.lit("Speaker_"), F.col("dense").cast("string"))
    )
    return r.select("rec", "win_idx", F.col("dense").cast("long").alias("dense"), name.alias("speaker"))


def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral clusters of each recording, told to find two where it found another number."""
    ship_package(spark)
    return cl.known_count(windows(spark, sf_dir), ["rec"], 2)


def streams_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture clusters over both streams of each recording together (even and odd windows)."""
    ship_package(spark)
    w = windows(spark, sf_dir)
    return cl.cluster_windows(w, ["rec"], method="gmm").withColumn("stream", F.col("win_idx") % 2)


def joint_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both streams of a recording clustered together, without what leaks from one into the other.

    Neighbouring windows are one frame of both streams; their power is the mean
    square of their values.
    """
    ship_package(spark)
    w = windows(spark, sf_dir)
    told = cl.cluster_windows(w, ["rec"], method="gmm").join(w.select("win_idx", "emb"), "win_idx")
    frames = told.select(
        "rec",
        F.floor(F.col("win_idx") / 2).cast("long").alias("frame"),
        (F.col("win_idx") % 2).alias("stream"),
        F.col("cluster").alias("speaker"),
        F.round(cl.dot(F.col("emb"), F.col("emb")) * 1_000_000 / F.size("emb")).cast("long").alias("power"),
    )
    return dz.prune_leakage(frames, ["rec"])


def best_voice_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window the label of its recording whose mean fingerprint is nearest, and the gap to its own."""
    w = windows(spark, sf_dir).withColumn("u", cl.normalised(F.col("emb")))
    c = cl.centroids(w, ["rec", "label"], "u").select("rec", F.col("label").alias("voice"), cl.normalised(F.col("centroid")).alias("c"))
    s = w.join(c, "rec").select("rec", "win_idx", "label", "voice", F.round(cl.dot(F.col("u"), F.col("c")), 8).alias("s"))
    best = F.max(F.struct("s", (-F.col("voice")).alias("v")))
    return s.groupBy("rec", "win_idx").agg(best.alias("b"), F.max(F.when(F.col("label") == F.col("voice"), F.col("s"))).alias("own")).select(
        "rec",
        "win_idx",
        (-F.col("b.v")).alias("voice"),
        F.round(F.col("b.s") - F.col("own"), 6).alias("gap"),
    )


def separated_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring windows as both tracks of a unit: which of them is the first one's label, and not the second one's."""
    w = windows(spark, sf_dir).withColumn("u", cl.normalised(F.col("emb")))
    c = cl.centroids(w, ["rec", "label"], "u").select("rec", F.col("label").alias("speaker"), cl.normalised(F.col("centroid")).alias("centroid"))
    tracks = w.select(
        "rec",
        (F.col("win_idx") - F.col("win_idx") % 2).alias("unit"),
        (F.col("win_idx") % 2).cast("int").alias("track"),
        F.col("u").alias("emb"),
        "label",
    )
    # A unit's partner is the label of its second window, where that is another one.
    who = tracks.groupBy("rec", "unit").agg(
        F.max(F.when(F.col("track") == 0, F.col("label"))).alias("speaker"),
        F.max(F.when(F.col("track") == 1, F.col("label"))).alias("second"),
    )
    named = tracks.drop("label").join(who.where("speaker is not null"), ["rec", "unit"]).withColumn(
        "other",
        F.when(F.col("second") != F.col("speaker"), F.col("second")),
    ).drop("second")
    return dz.pick_voice(named, c, ["rec"]).select("rec", "unit", F.col("track").cast("long").alias("track"), F.round("score", 6).alias("score"))


def ctc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame labels from 0 to 3 of each window, decoded greedily; 0 is the blank."""
    ids = F.transform("emb", lambda x: F.floor(F.abs(x) * 8) % 4)
    return windows(spark, sf_dir).select("win_idx", F.array_join(tx.ctc_collapse(ids, 0).cast("array<string>"), "").alias("said"))


def _duo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring windows as two sources, with estimates that leak into each other and come out swapped for odd pairs."""
    w = windows(spark, sf_dir).select((F.floor(F.col("win_idx") / 2)).cast("long").alias("pair"), (F.col("win_idx") % 2).alias("side"), "emb")
    a = w.where("side = 0").select("pair", F.col("emb").alias("a"))
    b = w.where("side = 1").select("pair", F.col("emb").alias("b"))
    leak = lambda x, y: F.zip_with(x, y, lambda p, q: p + q * 0.25)
    j = a.join(b, "pair").withColumn("x", leak("a", "b")).withColumn("y", leak("b", "a"))
    odd = F.col("pair") % 2 == 1
    return j.select(
        "pair",
        "a",
        "b",
        F.when(odd, F.col("y")).otherwise(F.col("x")).alias("e0"),
        F.when(odd, F.col("x")).otherwise(F.col("y")).alias("e1"),
        F.zip_with("a", "b", lambda p, q: p + q).alias("mix"),
    )


def si_sdr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each pair under the better of both orders, and that order."""
    s = _duo(spark, sf_dir).withColumn("straight", (si_sdr(F.col("e0"), F.col("a")) + si_sdr(F.col("e1"), F.col("b"))) / 2).withColumn(
        "crossed",
        (si_sdr(F.col("e1"), F.col("a")) + si_sdr(F.col("e0"), F.col("b"))) / 2,
    )
    return s.select("pair", F.round(F.greatest("straight", "crossed"), 4).alias("si_sdr"), (F.col("crossed") > F.col("straight")).alias("swapped"))


def output_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each pair's outputs against both sources, outputs without an order being matched."""
    d = _duo(spark, sf_dir).select(
        "pair",
        F.lit("leak").alias("name"),
        F.col("e0").alias("out0"),
        F.col("e1").alias("out1"),
        F.col("a").alias("ref0"),
        F.col("b").alias("ref1"),
        (F.col("pair") % 3 == 0).alias("fixed"),
    )
    return output_table(d, ["pair"])


def matched_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four windows after the other: the first two as tracks, named after the next two as speakers."""
    w = windows(spark, sf_dir).select(
        F.floor(F.col("win_idx") / 4).cast("long").alias("unit"),
        (F.col("win_idx") % 4).alias("place"),
        cl.normalised(F.col("emb")).alias("u"),
    )
    tracks = w.where("place < 2").select("unit", F.col("place").cast("int").alias("track"), "u")
    speakers = w.where("place >= 2").select("unit", (F.col("place") - 1).alias("rank"), F.col("u").alias("v"))
    scores = tracks.join(speakers, "unit").select("unit", "track", "rank", F.round(cl.dot(F.col("u"), F.col("v")), 9).alias("score"))
    return dz.match_tracks(scores, ["unit"])


def separation_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the best order improves on the mixture."""
    d = _duo(spark, sf_dir)
    best = F.greatest(
        (si_sdr(F.col("e0"), F.col("a")) + si_sdr(F.col("e1"), F.col("b"))) / 2,
        (si_sdr(F.col("e1"), F.col("a")) + si_sdr(F.col("e0"), F.col("b"))) / 2,
    )
    mix = (si_sdr(F.col("mix"), F.col("a")) + si_sdr(F.col("mix"), F.col("b"))) / 2
    return d.select("pair", F.round(mix, 4).alias("si_sdr_mix"), F.round(best - mix, 4).alias("gain"))


def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, active level, decibels, gain to a peak of 0.9 and the trimmed length of each window as a signal."""
    w = windows(spark, sf_dir)
    power = cl.dot(F.col("emb"), F.col("emb")) / F.size("emb")
    frames = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: cl.dot(F.slice("emb", i * 8 + 1, F.lit(8)), F.slice("emb", i * 8 + 1, F.lit(8))) / 8,
    )
    peak = F.array_max(F.transform("emb", lambda x: F.abs(x)))
    w = w.withColumn("frames", frames).withColumn("loud", F.array_max("frames") / 4)
    on = F.filter("frames", lambda f: f >= F.col("loud"))
    active = F.aggregate(on, F.lit(0.0), lambda s, x: s + x) / F.size(on)
    places = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("frames", i) >= F.col("loud"))
    return w.select(
        "win_idx",
        F.round(F.sqrt(power + 1e-9), 6).alias("rms"),
        F.round(F.sqrt(active + 1e-9), 6).alias("active_rms"),
        F.round(10 * F.log10(power + 1e-12), 4).alias("db"),
        F.round(0.9 / peak, 5).alias("gain"),
        ((F.array_max(places) - F.array_min(places) + 1) * 8).cast("long").alias("trimmed"),
    )


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


_W = """WITH w AS (SELECT vec_id // 50 AS rec, vec_id AS win_idx, label, embedding::DOUBLE[] AS emb FROM embeddings),
un AS (SELECT rec, win_idx, label, list_transform(emb, lambda x: x / (sqrt(""" + _dot("emb", "emb") + """) + 1e-9::DOUBLE)) AS u FROM w),
sims AS (SELECT a.rec, a.win_idx, b.win_idx AS other, """ + _dot("a.u", "b.u") + """ AS sim FROM un a JOIN un b ON a.rec = b.rec)
"""
_C = ", {n} AS (SELECT {k}, list(v ORDER BY d) AS c, max(n) AS n FROM (SELECT {k}, d, avg(v) AS v, count(*) AS n FROM (SELECT {k}, unnest(u) AS v, generate_subscripts(u, 1) AS d FROM un) GROUP BY ALL) GROUP BY {k})"
_DUO = """WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS emb FROM embeddings), j AS (SELECT a.vec_id // 2 AS pair, a.emb AS a, b.emb AS b FROM w a JOIN w b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
x AS (SELECT *, list_transform(list_zip(a, b), lambda z: z[1] + z[2] * 0.25::DOUBLE) AS x, list_transform(list_zip(b, a), lambda z: z[1] + z[2] * 0.25::DOUBLE) AS y, list_transform(list_zip(a, b), lambda z: z[1] + z[2]) AS mix FROM j),
ab AS (SELECT pair, a, b, CASE WHEN pair % 2 = 1 THEN y ELSE x END AS e0, CASE WHEN pair % 2 = 1 THEN x ELSE y END AS e1, mix FROM x),
sig AS (SELECT pair, unnest(['0a', '1b', '1a', '0b', 'ma', 'mb']) AS k, unnest([e0, e1, e1, e0, mix, mix]) AS e, unnest([a, b, a, b, a, b]) AS r FROM ab),
ce AS (SELECT pair, k, list_transform(e, lambda v: v - list_avg(e)) AS e, list_transform(r, lambda v: v - list_avg(r)) AS r FROM sig),
al AS (SELECT *, """ + _dot("e", "r") + " / (" + _dot("r", "r") + """ + 1e-8::DOUBLE) AS alpha FROM ce),
tg AS (SELECT pair, k, e, list_transform(r, lambda v: v * alpha) AS t FROM al),
ns AS (SELECT pair, k, t, list_transform(list_zip(e, t), lambda z: z[1] - z[2]) AS n FROM tg),
db AS (SELECT pair, k, 10 * log10((""" + _dot("t", "t") + " + 1e-8::DOUBLE) / (" + _dot("n", "n") + """ + 1e-8::DOUBLE)) AS s FROM ns),
pv AS (SELECT pair, (max(s) FILTER (k = '0a') + max(s) FILTER (k = '1b')) / 2 AS straight, (max(s) FILTER (k = '1a') + max(s) FILTER (k = '0b')) / 2 AS crossed, (max(s) FILTER (k = 'ma') + max(s) FILTER (k = 'mb')) / 2 AS mix FROM db GROUP BY pair)
"""

QUERIES = {
    f.__name__: f for f in (
        cosine_topk,
        affinity_percentile,
        label_centroids,
        relabel_first_seen,
        cluster_assign,
        streams_assign,
        joint_streams,
        best_voice_pick,
        separated_voices,
        ctc_frames,
        si_sdr_pairs,
        separation_gain,
        output_scores,
        matched_tracks,
        signal_levels,
    )
}
ORACLES = {
    "cosine_topk": _W + "SELECT rec, win_idx, other, row_number() OVER (PARTITION BY rec, win_idx ORDER BY round(sim, 9) DESC, other) AS rank FROM sims QUALIFY rank <= 10",
    "affinity_percentile": _W + ", p AS (SELECT rec, quantile_cont(sim, 0.1) AS p FROM sims WHERE win_idx < other GROUP BY rec) SELECT rec, round(p, 6) AS p10, p > 0.55 AS one_speaker FROM p",
    "label_centroids": _W + _C.format(
        n="ct",
        k="label",
    ) + f" SELECT label, n, round(sqrt({_dot('c', 'c')}), 6) AS length, round(c[1], 6) AS first_value FROM ct",
    "relabel_first_seen": "WITH w AS (SELECT vec_id // 50 AS rec, vec_id AS win_idx, min(vec_id) OVER (PARTITION BY vec_id // 50, label) AS f FROM embeddings), d AS (SELECT rec, win_idx, dense_rank() OVER (PARTITION BY rec ORDER BY f) - 1 AS dense FROM w) SELECT rec, win_idx, dense, 'Speaker_' || CASE WHEN dense < 26 THEN chr((65 + dense)::INT) ELSE dense::VARCHAR END AS speaker FROM d",
    "best_voice_pick": _W + _C.format(
        n="ct",
        k="rec, label",
    ) + f", cu AS (SELECT rec, label AS voice, list_transform(c, lambda x: x / (sqrt({
        _dot('c', 'c')
    }) + 1e-9::DOUBLE)) AS c FROM ct), s AS (SELECT un.rec, win_idx, label, voice, round({_dot(
        'u',
        'c',
    )}, 8) AS s FROM un JOIN cu ON un.rec = cu.rec), b AS (SELECT *, max(CASE WHEN label = voice THEN s END) OVER (PARTITION BY rec, win_idx) AS own FROM s) SELECT rec, win_idx, voice, round(s - own, 6) AS gap FROM b QUALIFY row_number() OVER (PARTITION BY rec, win_idx ORDER BY s DESC, voice) = 1",
    "separated_voices": _W + _C.format(
        n="ct",
        k="rec, label",
    ) + f", cu AS (SELECT rec, label, list_transform(c, lambda x: x / (sqrt({
        _dot('c', 'c')
    }) + 1e-9::DOUBLE)) AS c FROM ct), who AS (SELECT rec, win_idx - win_idx % 2 AS unit, max(label) FILTER (win_idx % 2 = 0) AS speaker, max(label) FILTER (win_idx % 2 = 1) AS second FROM un GROUP BY ALL), s AS (SELECT un.rec, unit, win_idx % 2 AS track, round({
        _dot('u', 'a.c')
    } - CASE WHEN second <> speaker THEN coalesce({_dot(
        'u',
        'b.c',
    )}, 0) ELSE 0 END, 9) AS score FROM un JOIN who ON un.rec = who.rec AND unit = win_idx - win_idx % 2 JOIN cu a ON a.rec = un.rec AND a.label = speaker LEFT JOIN cu b ON b.rec = un.rec AND b.label = second) SELECT rec, unit, track, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY rec, unit ORDER BY score DESC, track) = 1",
    "ctc_frames": "WITH w AS (SELECT vec_id AS win_idx, list_transform(embedding::DOUBLE[], lambda x: floor(abs(x) * 8)::BIGINT % 4) AS f FROM embeddings) SELECT win_idx, array_to_string(list_filter(list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1]), lambda x: x <> 0), '') AS said FROM w",
    "si_sdr_pairs": _DUO + "SELECT pair, round(greatest(straight, crossed), 4) AS si_sdr, crossed > straight AS swapped FROM pv",
    "output_scores": _DUO
    + """, k AS (SELECT pair, max(s) FILTER (k = '0a') AS s00, max(s) FILTER (k = '1b') AS s11, max(s) FILTER (k = '1a') AS s10, max(s) FILTER (k = '0b') AS s01 FROM db GROUP BY pair),
c AS (SELECT *, pair % 3 <> 0 AND s10 + s01 > s00 + s11 AS swapped FROM k)
SELECT pair, 'leak' AS name, round(CASE WHEN swapped THEN s10 ELSE s00 END, 1) AS first_db, round(CASE WHEN swapped THEN s01 ELSE s11 END, 1) AS second_db, swapped FROM c""",
    "matched_tracks": _W
    + ", p AS (SELECT a.win_idx // 4 AS unit, round("
    + _dot("a.u", "c.u")
    + " , 9) AS s01, round("
    + _dot("a.u", "d.u")
    + ", 9) AS s02, round("
    + _dot("b.u", "c.u")
    + ", 9) AS s11, round("
    + _dot("b.u", "d.u")
    + ", 9) AS s12 FROM un a JOIN un b ON a.win_idx % 4 = 0 AND b.win_idx = a.win_idx + 1 JOIN un c ON c.win_idx = a.win_idx + 2 JOIN un d ON d.win_idx = a.win_idx + 3) SELECT unit, unnest([0, 1]) AS track, unnest(CASE WHEN s02 + s11 > s01 + s12 THEN [2, 1] ELSE [1, 2] END)::BIGINT AS rank FROM p",
    "separation_gain": _DUO + "SELECT pair, round(mix, 4) AS si_sdr_mix, round(greatest(straight, crossed) - mix, 4) AS gain FROM pv",
    "signal_levels": "WITH w AS (SELECT vec_id AS win_idx, embedding::DOUBLE[] AS emb FROM embeddings), f AS (SELECT *, list_transform(range(8), lambda i: " + _dot(
        "emb[i * 8 + 1 : i * 8 + 8]",
        "emb[i * 8 + 1 : i * 8 + 8]",
    ) + " / 8) AS frames, " + _dot("emb", "emb") + " / 64 AS power FROM w), g AS (SELECT *, list_max(frames) / 4 AS loud FROM f), h AS (SELECT *, list_filter(frames, lambda x: x >= loud) AS on_, list_filter(range(8), lambda i: frames[i + 1] >= loud) AS places FROM g) SELECT win_idx, round(sqrt(power + 1e-9::DOUBLE), 6) AS rms, round(sqrt(list_avg(on_) + 1e-9::DOUBLE), 6) AS active_rms, round(10 * log10(power + 1e-12::DOUBLE), 4) AS db, round(0.9::DOUBLE / list_max(list_transform(emb, lambda x: abs(x))), 5) AS gain, (list_max(places) - list_min(places) + 1) * 8 AS trimmed FROM h",
}
