"""Small literal cases of the operators, and brute force where SQL has no form."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import languages, signals, text as tx, transliterate
from parlance.operators import assignment, clustering, guardrails, intervals as iv, simulation, statistics
from parlance.operators.ranking import global_row_number
from parlance.sources import models, readers, writers


def turns(spark, rows):
    return spark.createDataFrame([("r", *r, k) for k, r in enumerate(rows)], "rec_id string, start double, end double, speaker string, seq int")


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_merge_turns_with_gap(spark):
    t = turns(spark, [(0.0, 2.0, "A"), (1.5, 3.0, "A"), (3.1, 4.0, "A"), (2.0, 3.0, "B")])
    assert sorted((r.start, r.end, r.speaker) for r in iv.merge_turns(t, ["rec_id"], 0.2, "seq").collect()) == [(0.0, 4.0, "A"), (2.0, 3.0, "B")]


def test_complement_intersection_and_windows(spark):
    a = spark.createDataFrame([("r", 1, 2), ("r", 3, 4)], "rec_id string, start long, end long")
    assert spans(iv.complement(a, ["rec_id"], 5)) == [(0, 1), (2, 3), (4, 5)]
    b = spark.createDataFrame([("r", 0, 2), ("r", 3, 5)], "rec_id string, start long, end long")
    c = spark.createDataFrame([("r", 1, 4)], "rec_id string, start long, end long")
    pairs = iv.intersecting(b, c, ["rec_id"], 2).select(F.greatest("start_a", "start_b").alias("start"), F.least("end_a", "end_b").alias("end"))
    assert spans(pairs) == [(1, 2), (3, 4)]
    regions = spark.createDataFrame([("r", 0, 5000), ("r", 6000, 6800), ("r", 7000, 7200)], "rec_id string, start long, end long")
    got = spans(iv.sliding_windows(regions, ["rec_id"], 1500, 750, 400))
    assert got[0] == (0, 1500) and (3500, 5000) in got and (6000, 6800) in got and not any(s >= 7000 for s, _ in got)


def test_touching_turns_do_not_overlap(spark):
    assert spans(iv.concurrency(turns(spark, [(0.0, 2.0, "A"), (2.0, 4.0, "B"), (3.0, 5.0, "A")]), ["rec_id"], "seq")) == [(3.0, 4.0)]


def test_smoothing(spark):
    def labels(runs):
        rows = [("r", k, v) for k, v in enumerate(itertools.chain(*([v] * n for n, v in runs)))]
        frames = spark.createDataFrame(rows, "rec_id string, frame long, label int")
        out = iv.smooth_runs(iv.run_lengths(frames, ["rec_id"]), ["rec_id"], 6).collect()
        return sorted((r.first, r.last, r.label) for r in out)

    assert labels([(20, 0), (2, 1), (20, 0)]) == [(0, 41, 0)]
    assert labels([(20, 0), (10, 1)]) == [(0, 19, 0), (20, 29, 1)]


@pytest.mark.parametrize("ref,hyp,unit,rate", [("एक दो तीन", "एक तीन", "word", 1 / 3), ("", "", "word", 0), ("a b", "A, b!", "word", 0)])
def test_word_error_rate(spark, ref, hyp, unit, rate):
    row = spark.createDataFrame([(ref, hyp)], "r string, h string").select(
        tx.word_edits(tx.words(F.col("r")), tx.words(F.col("h"))).alias("e"),
        F.size(tx.words(F.col("r"))).alias("n"),
    ).first()
    assert row.e / max(row.n, 1) == pytest.approx(rate)


def test_word_edits_against_dynamic_programming(spark):
    rng = np.random.default_rng(0)
    rows = [
        ([f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 30))], [f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 30))]) for _ in range(60)
    ]
    got = spark.createDataFrame(rows, "r array<string>, h array<string>").select("r", "h", tx.word_edits(F.col("r"), F.col("h")).alias("e")).collect()
    for row in got:
        prev = list(range(len(row.h) + 1))
        for i, r in enumerate(row.r, 1):
            cur = [i]
            for j, h in enumerate(row.h, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (r != h)))
            prev = cur
        assert row.e == prev[-1]


def test_assignment_is_cheapest(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5):
        for _ in range(20):
            cost = rng.integers(0, 20, (n, n))
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            got = assignment.cheapest(cost)
            assert sorted(got) == list(range(n)) and sum(cost[i, j] for i, j in enumerate(got)) == best


def test_diarization_error(spark):
    k = "rec_id string, label int, start long, end long"
    ref = spark.createDataFrame([("a", 0, 0, 5000), ("a", 1, 5000, 10_000), ("b", 0, 0, 10_000), ("c", 0, 0, 5000), ("c", 1, 5000, 10_000)], k)
    hyp = spark.createDataFrame([("a", 1, 0, 5000), ("a", 0, 5000, 10_000), ("b", 0, 0, 5000), ("c", 0, 0, 10_000)], k)
    for collar in (0, 250):
        got = {r.rec_id: r for r in assignment.der_parts(ref, hyp, ["rec_id"], collar=collar).collect()}
        conf = {i: (r.paired - r.matched) / r.total for i, r in got.items()}
        assert conf["a"] == 0 and conf["c"] == pytest.approx(0.5) and got["b"].missed / got["b"].total == pytest.approx(0.5, abs=0.02)


def voices(count, turns=30, dim=48):
    """Windows of ``count`` speakers on axes of their own, swaying towards two shared axes by a fixed rule."""
    who = np.arange(count * turns) % count
    sway = np.arange(count * turns)
    x = np.zeros((count * turns, dim))
    x[sway, 5 * who] = 1
    x[:, -1] += 0.25 * np.sin(sway * 1.7)
    x[:, -2] += 0.25 * np.cos(sway * 0.9)
    x[sway, 20 + sway % 17] += 0.2
    return x, who


def agreement(labels, who):
    """The share of pairs of windows on which two labellings agree."""
    return np.mean((labels[:, None] == labels) == (who[:, None] == who))


@pytest.mark.parametrize("k", [2, 3, 4])
@pytest.mark.parametrize("method", ["spectral", "gmm"])
def test_clustering_finds_the_speakers(k, method):
    x, who = voices(k)
    labels = clustering.consolidate(x, clustering.CLUSTERERS[method](x))
    assert agreement(labels, who) > 0.97 and len(set(labels)) == k


def test_consolidation_and_labels():
    x, who = voices(2)
    split = np.where(np.arange(60) < 12, who + 5, who)
    split[0] = 9  # a cluster of one window
    assert agreement(clustering.consolidate(x, split), who) == 1.0
    assert len(set(clustering.consolidate(x, split, merge_sim=None))) == 4
    assert clustering.consolidate(x[:1], np.array([3])).tolist() == [0]
    assert clustering.first_seen(np.array([2, 2, 0, 1, 0])).tolist() == [0, 0, 1, 2, 1]
    assert clustering.eigengap(np.array([0, 0.1, 0.1, 2.0, 2.1]), 1, 4) == 3 and clustering.eigengap(np.array([0.0, 1, 2]), 1, 2) == 1


def test_clusters_in_spark(spark):
    rows = [(f"r{k}", i, v.tolist(), int(t)) for k in (2, 3) for i, (v, t) in enumerate(zip(*voices(k), strict=True))]
    w = spark.createDataFrame(rows, "rec string, win_idx int, emb array<double>, truth int")
    got = clustering.cluster_windows(w, ["rec"]).join(w, ["rec", "win_idx"]).toPandas()
    for _, g in got.groupby("rec"):
        assert agreement(g["cluster"].to_numpy(), g["truth"].to_numpy()) > 0.97
    forced = clustering.known_count(w, ["rec"], 2).groupBy("rec").agg(F.count_distinct("cluster").alias("n")).collect()
    assert {r.n for r in forced} == {2}


def test_windows_in_blocks(spark):
    """Blocks change neither neighbours nor pairs."""
    x = np.random.default_rng(0).normal(size=(40, 8))
    w = spark.createDataFrame(
        [("r", k, v.tolist()) for k, v in enumerate(x)] + [("one", 7, x[0].tolist())],
        "rec string, win_idx long, emb array<double>",
    )
    sims = np.round(clustering.unit(x) @ clustering.unit(x).T, 9)
    for block in (7, 512):
        got = clustering.nearest_windows(w, "rec", "win_idx", 4, block=block).where("rec = 'r'").collect()
        assert {(r.win_idx, r["rank"]): r.other for r in got} == {
            (i, k + 1): j for i in range(40) for k, j in enumerate(sorted(range(40), key=lambda j: (-sims[i, j], j))[:4])
        }
        pairs = sorted(r.sim for r in clustering.pair_similarities(w, "rec", "win_idx", block=block).collect())
        assert np.allclose(pairs, np.sort(sims[np.triu_indices(40, 1)]), atol=1e-8)


def test_text_functions(spark):
    row = spark.createDataFrame([("नमस्ते, आप कैसे हैं।  ठीक?",)], "t string").select(
        tx.normalise(F.col("t")).alias("n"),
        tx.script_of(F.col("t")).alias("s"),
    ).first()
    assert row.n == "नमस्ते आप कैसे हैं ठीक" and row.s == "devanagari"
    c = spark.createDataFrame([(12.2,), (45.4,), (3661.0,), (0.5,)], "s double").select(tx.clock(F.col("s")).alias("c")).collect()
    assert [r.c for r in c] == ["00:12", "00:45", "1:01:01", "00:00"]
    wishes = [
        ("Maybe we should go", True),
        ("what is it?", True),
        ("Is he here?", True),
        ("I want a car", True),
        ("", True),
        ("Bring the card", False),
        ("Will you bring it?", False),
        ("S will do it", False),
    ]
    got = spark.createDataFrame(wishes, "t string, want boolean").select("want", tx.is_non_commitment(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


@pytest.mark.parametrize(
    "word,latin",
    [
        ("कमरा", "kamra"),
        ("समझना", "samajhna"),
        ("पढ़ते", "padhte"),
        ("दूध", "doodh"),
        ("ज़मीन", "zamin"),
        ("कंबल", "kambal"),
        ("नहीं", "nahi"),
        ("شکریہ", "shukriya"),
        ("OK", "OK"),
    ],
)
def test_romanise(word, latin):
    assert transliterate.romanise_word(word) == latin


def test_romanise_sentence_and_lexicon():
    assert transliterate.romanise("आज रेट है। OK?", {"रेट": "rate"}) == "aaj rate hai. OK?"


def test_languages():
    assert len(languages.CATALOGUE) == 22 and languages.resolve_language("BANGLA")[0] == "bn" and languages.resolve_language(None)[0] == "hi"
    with pytest.raises(ValueError, match="Unknown language"):
        languages.resolve_language("klingon")


LINES = [(1, 1, "sir sir my id card is lost today"), (1, 2, "please bring the aadhaar card to the office"), (1, 4, "I will come tomorrow with it")]


def checked(spark, replies, **options):
    lines = spark.createDataFrame(LINES, "conv_id long, line_id long, text string")
    r = spark.createDataFrame(replies, "conv_id long, line_id long, text string, english string, uncertain boolean, pos int")
    return {
        x.line_id: x for x in guardrails.check_replies(lines, r, ["conv_id"], **options).collect()
    }, guardrails.unknown_ids(lines, r, ["conv_id"]).collect()


def test_guardrails(spark):
    got, unknown = checked(
        spark,
        [
            (1, 1, "sir my id card is lost today", "en one", False, 0),
            (1, 1, "second", "x", False, 1),
            (1, 99, "no", "no", False, 0),
            (1, 2, "bring the aadhaar card to the office", "en two", True, 0),
        ],
    )
    assert unknown[0].unknown == 1 and sorted(got) == [1, 2, 4]
    assert got[1].changed and got[1].reason is None and not got[1].uncertain
    assert got[2].reason == "dropped" and got[2].text == LINES[1][2] and "hard to understand" in got[2].note
    assert "skipped" in got[4].note and got[4].uncertain
    got, _ = checked(spark, [(1, k, t + " ab cd ef", "the same english text", False, 0) for _, k, t in LINES])
    assert {x.reason for x in got.values()} == {"added"} and all(x.english == "" and "same English" in x.note for x in got.values())
    got, _ = checked(
        spark,
        [(1, 2, "please bring the aadhaar paper to the office", "कार्ड", False, 0), (1, 4, "zzzz qqqq xxxx", "ok " * 40, False, 0)],
        loanwords=["card"],
    )
    assert got[2].reason == "replaced" and got[2].english == "" and got[4].reason == "rewrote" and "much longer" in got[4].note


def test_chunks_and_reuse(spark):
    costs = spark.createDataFrame([(1, k, 100, 50) for k in range(1, 15)], "conv_id long, line_id long, prompt long, reply long")
    got = sorted((r.line_id, r.chunk) for r in guardrails.plan_chunks(costs, ["conv_id"], 820).collect())
    assert [c for _, c in got] == [k // 4 for k in range(14)]
    cache = spark.createDataFrame(
        [(1, None, None, None), (2, "r", "m", 4096), (3, "old", "m", 4096), (4, "r", "other", 4096), (5, "r", "m", 8192)],
        "id long, revision string, model string, context long",
    )
    use = lambda *a: sorted(r.id for r in cache.where(guardrails.compatible(*a)).collect())
    assert use("r", "m", 4096, "m") == [1, 2] and use("r", "m", 8192, "m") == [5] and use("r", "m", 4096, "d") == [2]


def test_model_boundary():
    tone = lambda s: np.zeros(int(s * signals.RATE), np.float32)
    assert models.transcribe([tone(0), tone(0.05), tone(2), tone(0.5)], models.DurationRecogniser()) == ["", "", "2.00", "0.50"]
    x = np.random.default_rng(0).normal(size=65 * signals.RATE).astype(np.float32)
    x[27 * signals.RATE : int(27.3 * signals.RATE)] = 0
    assert 27 <= len(signals.split_at_quiet(x, 30)[0]) / signals.RATE <= 27.3
    calls = []

    def ask(lines):
        calls.append(len(lines))
        if len(calls) < 3:
            raise models.ModelError("garbage")
        return {"lines": []}

    assert [len(a) for a, _ in models.ask_in_halves([{}, {}, {}], ask)] == [1, 2] and calls == [3, 1, 2]
    assert models.json_object('```json\nso: {"a": 1}\n```') == {"a": 1}
    with pytest.raises(models.ModelError):
        models.json_object("[1]")
    assert models.ctc_text([1, 1, 0, 1, 2], 0, ["", "▁a", "b"]) == "a ab"


def test_chunk_replies_in_spark(spark):
    from parlance.operators import reports

    lines = spark.createDataFrame([(1, 0, 1, "A", "x"), (1, 0, 2, "B", "y")], "conv_id long, chunk int, line_id long, speaker string, text string")
    reply = {
        "lines": [{"id": 1, "text": "X", "en": "e"}, {"id": float("inf"), "text": "no"}, {"line_id": 2, "cleaned": "Y", "uncertain": True}],
        "summary": "s",
    }
    got = reports.call_chunks(lines, lambda: models.ScriptedChat([reply]), "conv_id", "hi").where("line_id is not null").collect()
    assert sorted((r.line_id, r.text, r.english, r.uncertain) for r in got) == [(1, "X", "e", False), (2, "Y", "", True)]


def test_signals():
    rng = np.random.default_rng(0)
    t = np.arange(signals.RATE) / signals.RATE
    tone = np.sin(2 * np.pi * 220 * t)
    half = signals.resample(tone, 16_000, 8000)
    assert len(half) == 8000 and np.abs(half[200:-200] - np.sin(2 * np.pi * 220 * np.arange(8000) / 8000)[200:-200]).max() < 0.02
    x = np.concatenate([np.zeros(8000), tone, np.zeros(16_000), tone])
    assert [(round(a, 1), round(b, 1)) for a, b in signals.energy_regions(x, fill_gap=0.6)] == [(0.5, 1.5), (2.5, 3.5)]
    noise = signals.scale_to_snr(tone, rng.normal(size=16_000), 10)
    assert 20 * np.log10(signals.active_rms(tone) / signals.rms(noise)) == pytest.approx(10, abs=0.1)
    assert signals.pitch_class(138.59) == 1 and [signals.nearest_tonic(h) for h in (138.59, 149.4, 210.07)] == ["C#", "D", "B"]
    a, b = rng.normal(size=(2, 4000))
    assert np.allclose(signals.mixture_gains(np.stack([a, b]), 0.5 * a + 2 * b), [0.5, 2], atol=5e-3)
    quiet = signals.mixture_gains(np.stack([a, 1e-9 * b]), a + b)  # the ridge keeps a silent part from being blown up
    assert abs(quiet[0] - 1) < 0.1 and abs(quiet[1]) < 1e-3
    order = iter([1, -1, 1, -1, 1])
    at = iter(range(0, 4000, 1000))

    def model(piece):
        """Knows the sources, but scales each window as it likes and swaps every other one."""
        lo = next(at)
        return np.stack([3 * a, -0.5 * b])[:: next(order), lo : lo + len(piece)]

    for n in (4000, 1500):
        order, at = iter([1, -1, 1, -1, 1]), iter(range(0, 4000, 1000))
        out = signals.separate((a + b)[:n], model, 2000, 1000)
        assert out.shape == (2, n) and np.abs(out - np.stack([a, b])[:, :n]).max() < 0.15
    stereo = np.stack([tone, -0.5 * tone]).astype(np.float32)
    assert np.allclose(signals.clip(stereo), 0.25 * tone, atol=1e-6) and np.allclose(signals.clip(stereo.T), 0.25 * tone, atol=1e-6)
    assert models.transcribe([stereo], models.DurationRecogniser()) == ["1.00"]
    assert signals.peak_normalised(np.zeros(3))[1] == 1 and signals.peak_normalised(np.array([0.3, -0.6]))[1] == pytest.approx(1.5)
    assert np.allclose(signals.decode_wav(writers.wav_bytes(0.5 * tone)), 0.5 * tone, atol=1e-3)


def test_files(spark, tmp_path):
    t = spark.createDataFrame([("id", 0.35, 0.803, "S3"), ("id", 2.0, 3.0, "S1")], "rec_id string, start double, end double, speaker string")
    writers.rttm_lines(t).coalesce(1).write.text(f"file://{tmp_path}/rttm")
    assert sorted((r.rec_id, r.speaker, r.start, round(r.end, 3)) for r in readers.read_rttm(spark, f"file://{tmp_path}/rttm").collect()) == [
        ("id", "S1", 2.0, 3.0),
        ("id", "S3", 0.35, 0.803),
    ]
    (tmp_path / "t.json").write_text(
        '{"duration_s": 4.0, "lines": [{"speaker": "A", "start": 0, "end": 1.5, "text": " hi ", "hinglish": "h"}, {"text": ""}, {"speaker": "B", "start": 2, "end": 3, "text": "yo", "latin": "l"}]}'
    )
    lines = readers.read_transcripts(spark, f"file://{tmp_path}/t.json").cache()
    assert [(r.line_id, r.speaker, r.text, r.latin) for r in lines.orderBy("line_id").collect()] == [
        (1, "A", "hi", "h"),
        (2, "Speaker_?", "", ""),
        (3, "B", "yo", "l"),
    ]
    srt = writers.subtitles(lines, "file").first().srt
    assert srt.startswith("1\n") and "00:00:02,000 --> 00:00:03,000\nB: yo" in srt and "\n3\n" in srt
    assert writers.transcript_text(lines, "file").first().text == "[00:00 - 00:02] A: hi\n[00:02 - 00:03] B: yo"
    assert '"speaker":"S3"' in writers.timeline_json(t).first().json
    (tmp_path / "lex.tsv").write_text("# c\n\nरेट\trate\n", encoding="utf-8")
    assert [(r.word, r.latin) for r in readers.read_lexicon(spark, f"file://{tmp_path}/lex.tsv").collect()] == [("रेट", "rate")]
    (tmp_path / "a.svl").write_text('<model sampleRate="100"/><point frame="250" label="1.2"/><point frame="50" label="1.1"/>')
    assert sorted((r.cycle, r.beat, r.t) for r in readers.read_beats(spark, f"file://{tmp_path}/a.svl").collect()) == [(1, 1, 0.5), (1, 2, 2.5)]
    for n in ("x__ta-c#-1.wav", "x__ta-c#-2.wav", "y__dhin-b-3.wav"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted((r.stroke, r.take) for r in readers.list_strokes(spark, f"file://{tmp_path}/*.wav", "dev").collect()) == [("dhin", 3), ("ta", 1)]


def test_corpora(spark, tmp_path):
    rows = [
        ("<noise> नमस्ते", 2.0, "s1", "Conversation", "t", "f", "d", (b"x", "rec_chunk_7.flac")),
        (None, 1.0, "s2", "Read", "t", "m", "d", (None, "odd.wav")),
    ]
    spark.createDataFrame(
        rows,
        "text string, duration double, speaker_id string, scenario string, task_name string, gender string, district string, audio_filepath struct<bytes: binary, path: string>",
    ).write.parquet(f"file://{tmp_path}/iv")
    df = readers.read_chunked_speech(spark, f"file://{tmp_path}/iv")
    assert sorted((r.recording, r.chunk, r.text) for r in df.collect()) == [("odd.wav", 0, ""), ("rec", 7, "नमस्ते")]
    assert "bytes" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    field = [(1.0, "s", "f", "d", "Yes", "स्मार्ट {smart} फोन", (b"x",)), (2.0, "t", "m", "d", None, None, (None,))]
    spark.createDataFrame(
        field,
        "duration double, speakerID string, gender string, district string, isTranscriptionAvailable string, transcript string, audio struct<bytes: binary>",
    ).write.parquet(f"file://{tmp_path}/va")
    assert sorted(str(r.transcribed) for r in readers.read_field_speech(spark, f"file://{tmp_path}/va").collect()) == ["None", "True"]
    got = {r.text: r.english for r in readers.read_transcribed_field_speech(spark, f"file://{tmp_path}/va").collect()}
    assert got == {"स्मार्ट फोन": {0: "smart"}, "": {}}


def test_simulated_turns_never_three_at_once(spark):
    for overlap in (0.0, 1.0):
        for seed in range(8):
            t = simulation.plan_turns(3, overlap, 60.0, seed)
            most = max(((t["start"] < e) & (t["end"] > s)).sum() for s, e in zip(t["start"] + 1e-4, t["start"] + 2e-4, strict=True))
            assert most <= (2 if overlap else 1)


def test_ranking_and_medians(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), (F.col("id") % 3).alias("g"))
    got = global_row_number(df, [F.col("v")]).orderBy("v").collect()
    assert [r.row_number for r in got] == list(range(1, 1001))
    med = {r.g: r.v for r in statistics.upper_median_rows(df, "g", ["v"]).collect()}
    for g in range(3):
        own = sorted(r.v for r in df.where(f"g = {g}").collect())
        assert med[g] == own[len(own) // 2]


def test_stream_equals_batch_in_several_passes(spark, tmp_path):
    from parlance.streaming import live

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"file://{tmp_path}/in")
    stream = live.talk_time(live.event_stream(spark, f"file://{tmp_path}/in"))
    live.versioned(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    batch = live.talk_time(events.withColumn("at", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, live.latest(spark, f"file://{tmp_path}/out").select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert spark.read.parquet(f"file://{tmp_path}/out").select("version").distinct().count() > 1
    assert live.sessions(events.withColumn("at", F.col("ts").cast("timestamp"))).count() > 0


def test_llm_part_is_optional(tmp_path):
    """A copy without the training-data folders and pipeline registers and answers all the rest."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    copy = tmp_path / "repo"
    shutil.copytree(Path(__file__).resolve().parents[1], copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert not (copy / "parlance" / "llm").exists()
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, timeout=60).returncode == 0
    # A fault inside the subpackage is no absence: it shows.
    (copy / "corpus_pipeline.py").write_text("import a_module_that_nobody_has\n")
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, timeout=60, capture_output=True, text=True)
    assert found.returncode and "a_module_that_nobody_has" in found.stderr


def test_sound_colour_and_noise():
    rng = np.random.default_rng(0)
    t = np.arange(signals.RATE) / signals.RATE
    tone, hiss = np.sin(2 * np.pi * 220 * t), rng.normal(size=signals.RATE)
    a, b, c = signals.timbre(hiss), signals.timbre(3 * hiss), signals.timbre(tone)
    assert a.shape == (97,) and np.abs(a - b).max() < 0.05 and np.linalg.norm(a - c) > 1
    bed = signals.soundscape(32_000, hiss, [tone[:4000]], 1, per_minute=120)
    assert len(bed) == 32_000 and np.array_equal(bed, signals.soundscape(32_000, hiss, [tone[:4000]], 1, per_minute=120))


def test_duo_plan():
    cycles = [[k * 8.0 + b for b in range(9)] for k in range(20)]
    plan = simulation.plan_duo(cycles, 45.0, 3, accompanied=1.0, partial=0.0)
    voice = plan[plan.part == "voice"]
    assert (plan.end > plan.start).all() and (voice.start.to_numpy()[1:] >= voice.end.to_numpy()[:-1]).all()
    assert set(simulation.plan_duo(cycles, 45.0, 3, accompanied=0.0, interlude=0.0).part) == {"voice"}


def test_chat_client_against_a_server():
    import json
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer

    fine = json.dumps(
        {"choices": [{"message": {"content": "{}"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 7, "completion_tokens": None}}
    )
    script: list[tuple[int, str]] = []
    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append("response_format" in body)
            self.answer()

        def do_GET(self):
            self.answer()

        def answer(self):
            status, data = script.pop(0)
            if not status:
                time.sleep(1.5)
                return
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    waits = []
    chat = models.HttpChat(f"http://127.0.0.1:{server.server_port}", "m", 1, tries=2, pause=waits.append)
    ask = lambda: chat.complete("s", "u", 10, {"type": "object"})
    script += [(503, "loading"), (200, "[]")]
    chat.ping(10, 5)
    # A bad request that is not about the schema leaves it on.
    script += [(400, "bad temperature")]
    with pytest.raises(models.Refused):
        ask()
    assert chat.use_schema and seen == [True]
    script += [(503, "busy"), (400, "response_format is unknown"), (200, fine), (200, fine)]
    assert ask() == "{}" == ask() and seen[1:] == [True, True, False, False] and not chat.use_schema
    assert (chat.usage.calls, chat.usage.prompt_tokens, chat.usage.completion_tokens) == (2, 14, 0)
    script += [(400, "the prompt exceeds the context size")]
    with pytest.raises(models.TooLong):
        ask()
    script += [(200, "no json")]
    with pytest.raises(models.ModelError, match="JSON"):
        ask()
    script += [(0, "")]
    with pytest.raises(models.TooLong):  # no answer in time: smaller parts may do
        ask()
    time.sleep(1.6)
    script += [(503, "busy")] * 3
    with pytest.raises(models.ConnectionFailed):  # busy to the end: nothing will do
        ask()
    server.shutdown()
    server.server_close()
    for call in (ask, chat.ping):
        with pytest.raises(models.ConnectionFailed):
            call()


def test_simulated_conversations_differ(spark):
    from parlance.runtime import ship_package

    ship_package(spark)
    plans = simulation.simulate(simulation.paired_design(spark, 4), 20.0).groupBy("id").agg(
        F.sort_array(F.collect_list("start")).alias("starts")
    ).collect()
    assert len(plans) == 36 and len({tuple(p.starts) for p in plans}) == 36


def test_more_words_than_a_plane_of_characters(spark):
    """Also across the surrogates, which are no characters."""
    rows = [([f"w{k}" for k in range(60)], [f"w{k}" for k in range(60) if k % 10])]
    got = spark.createDataFrame(rows, "r array<string>, h array<string>").select(
        *(tx.word_edits(F.col("r"), F.col("h"), start).alias(f"e{start}") for start in (0x3400, 0xD7E0, 0xFFF0))
    ).first()
    assert tuple(got) == (6, 6, 6)


def test_repairs_are_judged_by_bounded_distance(spark):
    cases = [
        ("a b c d", "a b c d!", None),
        ("abcd efgh", "abcx exxh", None),
        ("abcd efgh", "abxx xxxh", "rewrote"),
        ("a b", "a b c d", "rewrote"),
        ("one two three four", "one two three four x y z", "added"),
        ("one one two three", "one two three", None),
        ("one one two three", "two three", "dropped"),
        ("", "x", "rewrote"),
    ]
    got = spark.createDataFrame([c[:2] for c in cases], "s string, t string").select(
        "s",
        "t",
        guardrails.revert_reason(F.col("s"), F.col("t")).alias("r"),
    ).collect()
    assert [(r.s, r.t, r.r) for r in got] == cases


def test_command_line(capsys):
    from parlance.__main__ import main, parser

    main(["list"])
    assert "talk_time" in capsys.readouterr().out
    assert parser().parse_args(["run", "talk_time", "--data", "x"]).name == "talk_time"


def test_translation_parts_come_through(spark):
    from parlance.functions import translation
    from parlance.runtime import ship_package

    assert translation.tidy("“a” ( b ) : १२३  %…") == '"a" (b):123%...'
    text, parts = translation.protect("mail a.b@c.org or see http://x.org/q?y=1 at 10:30 on 12/05/2024, 12345 people, #tag")
    assert parts == ["a.b@c.org", "http://x.org/q?y=1", "10:30", "12/05/2024", "12345", "#tag"] and "<ID2>" in text
    assert translation.restore(text.replace("<ID1>", "< id 1 >").replace("<ID6>", "[ID6]"), parts).startswith("mail a.b@c.org or see http://x.org")
    ship_package(spark)
    row = spark.createDataFrame([("to a@b.cd",), (None,)], "t string").withColumn("p", translation.protected("t")).select(
        translation.restored("p.text", "p.parts").alias("r")
    ).collect()
    assert [r.r for r in row] == ["to a@b.cd", ""]
