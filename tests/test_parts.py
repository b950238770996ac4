"""Writers, readers, guards and score parts on literal cases."""

import itertools
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import assignment, simulation
from parlance.runtime import ship_package
from parlance.sources import readers, writers
from parlance.streaming import live


def test_transcripts_go_through_json(spark, tmp_path):
    lines = spark.createDataFrame(
        [("r", 2, 3.0, 4.0, "B", "yo", "yo"), ("r", 1, 0.5, 1.5, "A", "hi", "hi")],
        "rec_id string, line_id long, start double, end double, speaker string, text string, latin string",
    )
    recordings = spark.createDataFrame(
        [("r", "B", "hi", 5.0), ("silent", "B", "hi", 1.0)],
        "rec_id string, order string, language string, duration_s double",
    )
    made = {r.rec_id: json.loads(r.json) for r in writers.transcript_json(lines, recordings).collect()}
    assert made["silent"]["lines"] == [] == made["silent"]["speakers"] and made["r"]["speakers"] == ["A", "B"]
    (tmp_path / "t.json").write_text(json.dumps(made["r"]))
    back = readers.read_transcripts(spark, f"file://{tmp_path}/t.json").orderBy("line_id").collect()
    assert [(r.speaker, r.start, r.text, r.order, r.duration_s) for r in back] == [("A", 0.5, "hi", "B", 5.0), ("B", 3.0, "yo", "B", 5.0)]


def test_tables_and_bundles(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b,c", None)], "name string, x double")
    writers.write_table(df, f"file://{tmp_path}/csv")
    assert sorted(
        map(tuple, readers.read_facts(spark, f"file://{tmp_path}/csv", "name string, x double").collect()),
        key=str,
    ) == [("a", 1.5), ("b,c", None)]
    reports = spark.createDataFrame([("c1", "T", ["k"])], "conv_id string, title string, keywords array<string>")
    assert json.loads(writers.report_json(reports).first().json) == {"title": "T", "keywords": ["k"]}
    conv = spark.createDataFrame([("c1", "dev"), ("c2", "test")], "id string, split string")
    writers.write_conversations(conv, conv.withColumn("start", F.lit(0.0)), f"file://{tmp_path}/set")
    assert [r.id for r in spark.read.parquet(f"file://{tmp_path}/set/turns").where("split = 'dev'").collect()] == ["c1"]


def test_tonics_beds_and_tracks(spark, tmp_path):
    (tmp_path / "tonics.yaml").write_text("# hz\nAnna: 138.5  # low\nbob: 210\nother:\n  nested: 1\n")
    assert sorted(map(tuple, readers.read_tonics(spark, f"file://{tmp_path}/tonics.yaml").collect())) == [("anna", 138.5), ("bob", 210.0)]
    bed = spark.createDataFrame([("b", [1.0, 2.0, 3.0, 4.0, 5.0])], "name string, samples array<double>")
    assert [readers.noise_beds(bed, s).first().samples for s in ("dev", "test")] == [[1.0, 2.0], [3.0, 4.0, 5.0]]
    audio = spark.createDataFrame([("r", "mix", [1.0]), ("r", "A", [2.0]), ("r", "B", [3.0])], "rec_id string, name string, samples array<double>")
    row = readers.with_tracks(spark.createDataFrame([("r",)], "rec_id string"), audio).first()
    assert row.mix == [1.0] and row.sources == {"A": [2.0], "B": [3.0]}


def test_references_are_found_anew(spark):
    ship_package(spark)
    quiet, loud = np.zeros(16_000), np.sin(np.arange(16_000) * 0.2)
    rows = [("r", "A", np.concatenate([quiet, loud]).tolist()), ("r", "B", np.concatenate([loud, quiet]).tolist())]
    got = simulation.refreshed_references(spark.createDataFrame(rows, "rec_id string, speaker string, samples array<double>")).collect()
    assert sorted((r.speaker, round(r.start, 1), round(r.end, 1)) for r in got) == [("A", 1.0, 2.0), ("B", 0.0, 1.0)]


def test_the_tuning_group_is_left_out(spark):
    df = spark.range(10).withColumnRenamed("id", "grp")
    assert {r.grp for r in simulation.without_tuning(df, "grp").collect()} == set(range(10)) - {7}
    assert {r.grp for r in simulation.without_tuning(df, "grp", [1, 2]).collect()} == {1, 2}
    with pytest.raises(ValueError, match="tuned on"):
        simulation.without_tuning(df, "grp", [1, 7])


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("unit", ["word", "char"])
def test_errors_under_the_best_assignment(spark, unit):
    """Against all permutations, with words and with characters."""
    rng = np.random.default_rng(3)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 30, n)]
    refs = {"x": {"A": say(8), "B": say(5), "C": say(3)}, "y": {"A": say(4)}, "z": {"A": [], "B": say(2)}}
    hyps = {"x": {"1": say(6), "2": say(6)}, "y": {"1": say(4), "2": say(2)}, "z": {"1": say(2)}}
    table = lambda d: spark.createDataFrame([(k, s, w) for k, v in d.items() for s, w in v.items()], "id string, speaker string, words array<string>")
    got = {r.id: (r.errors, r.n_ref) for r in assignment.cp_errors(table(refs), table(hyps), ["id"], unit).collect()}
    form = (lambda w: w) if unit == "word" else "".join
    for k in refs:
        a, b = [form(w) for w in refs[k].values()], [form(w) for w in hyps[k].values()]
        n = max(len(a), len(b))
        a, b = a + [form([])] * (n - len(a)), b + [form([])] * (n - len(b))
        assert got[k] == (
            min(sum(edits(x, b[p]) for x, p in zip(a, order, strict=True)) for order in itertools.permutations(range(n))),
            sum(map(len, a)),
        )


def events(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"file://{tmp_path}/in")
    return live.event_stream(spark, f"file://{tmp_path}/in")


def test_live_guards(spark, tmp_path):
    stream = live.talk_time(events(spark, tmp_path))
    takes = iter(["one"] + ["two"] * 9)
    live.versioned(stream, f"file://{tmp_path}/stale", f"file://{tmp_path}/s1", take=lambda: next(takes)).awaitTermination()
    assert not (tmp_path / "stale").exists()  # another take has begun
    live.versioned(stream, f"file://{tmp_path}/few", f"file://{tmp_path}/s2", ready=live.enough(10**12)).awaitTermination()
    assert not (tmp_path / "few").exists()  # nothing is shown before there is enough
    live.versioned(stream, f"file://{tmp_path}/good", f"file://{tmp_path}/s3", take=lambda: "one", ready=live.enough()).awaitTermination()
    assert live.latest(spark, f"file://{tmp_path}/good").count() > 0
    going = live.versioned(stream, f"file://{tmp_path}/long", f"file://{tmp_path}/s4", everything=False)
    live.bounded(going, 1)
    assert not going.isActive


def test_sessions_settle_in_append_mode(spark, tmp_path):
    """Only sessions that the watermark has passed come out, and each once."""
    base = "2024-01-01 00:{}:00"
    rows = [[(k, base.format(m), 1, "view", 0.1, "{}") for k, m in part] for part in ([(1, "00"), (2, "05")], [(3, "40")], [(4, "59")])]
    for n, part in enumerate(rows):
        df = spark.createDataFrame(part, "event_id long, t string, user_id long, event_type string, value double, props string")
        df.select(
            "event_id",
            F.to_timestamp_ntz("t").alias("ts"),
            "user_id",
            "event_type",
            "value",
            "props",
        ).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    out = live.settled(live.event_stream(spark, f"file://{tmp_path}/in", files_per_trigger=1))
    query = out.writeStream.outputMode("append").option(
        "checkpointLocation",
        f"file://{tmp_path}/state",
    ).option("path", f"file://{tmp_path}/out").format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert 1 <= len(got) <= 3 and len({r.start for r in got}) == len(got)


def test_texts_are_asked_for_once(spark, tmp_path):
    rows = [(1, "hi", "a"), (2, "hi", "a"), (3, "en", "a"), (4, "hi", "b")]
    spark.createDataFrame(rows, "s long, lang string, text string").select(
        F.timestamp_seconds("s").alias("at"),
        "lang",
        "text",
    ).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, lang string, text string").parquet(f"file://{tmp_path}/in").withWatermark("at", "1 hour")
    live.new_texts(stream).writeStream.outputMode("append").option(
        "checkpointLocation",
        f"file://{tmp_path}/state",
    ).option("path", f"file://{tmp_path}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.lang, r.text) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("en", "a"), ("hi", "a"), ("hi", "b")]


def test_picked_rows_reach_the_scan(spark, tmp_path, capsys):
    spark.range(1000).select("id", (F.col("id") * 2).alias("wide")).write.parquet(f"file://{tmp_path}/t")
    picks = spark.createDataFrame([(7, 1), (900, 0)], "id long, place int")
    source = spark.read.parquet(f"file://{tmp_path}/t")
    got = readers.take_rows(source, picks, "id")
    assert [(r.id, r.wide) for r in got.collect()] == [(900, 1800), (7, 14)]
    got.explain()
    assert "In(id, [" in capsys.readouterr().out
    assert [r.id for r in readers.take_rows(source, picks, "id", pushed=1).collect()] == [900, 7]


def test_conversations_are_rendered():
    plan = simulation.plan_turns(2, 0.7, 12.0, 5)
    rng = np.random.default_rng(1)
    clips = {s: rng.normal(size=20_000) * k for k, s in enumerate(sorted(plan["speaker"].unique()), 1)}
    mix, sources = simulation.render(plan, clips)
    assert np.allclose(sum(sources.values()), mix) and np.abs(mix).max() == pytest.approx(0.9)
    for turn in plan.itertuples():  # each turn is said, at the same level whoever says it
        part = sources[turn.speaker][int(turn.start * 16_000) + 400 : int(turn.end * 16_000) - 400]
        assert np.sqrt((part**2).mean()) == pytest.approx(np.sqrt((sources["S0"][sources["S0"] != 0] ** 2).mean()), rel=0.15)
    noisy, _ = simulation.render(plan, clips, noise=rng.normal(size=9000), snr_db=0)
    assert np.abs(noisy).max() == pytest.approx(0.9) and (noisy != 0).mean() > (mix != 0).mean()
    assert simulation.render(plan.iloc[:0], {})[0].shape == (0,)


def test_transducers_and_fallbacks():
    from parlance.sources import models

    # The state counts symbols said: frame k says k symbols, then blanks.
    join = lambda frame, state: [1.0, 0.0, 0.0] if state >= frame else [0.0, 0.0, 1.0]
    assert models.transducer_ids([1, 1, 3], 0, join, lambda s, _: s + 1, blank=0) == [2, 2, 2]
    assert models.transducer_ids([99], 0, join, lambda s, _: s + 1, blank=0, most=4) == [2] * 4

    def broken(texts):
        raise models.ModelError("no")

    assert models.first_that_works(broken, lambda t: [x.upper() for x in t])(["a"]) == ["A"]
    assert models.first_that_works(broken)(["a", "b"]) == ["", ""]


def test_parts_by_name():
    from parlance.operators.pipeline import Pipeline

    made = Pipeline.of(None, separator="hpss", order="A")
    assert made.separator is not None and made.order == "A"
    with pytest.raises(ValueError, match="unknown part voice"):
        Pipeline.of(None, fingerprint="voice")


def test_tables_are_made_once_per_version(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    get = lambda version: writers.cached(make, f"file://{tmp_path}", "t", version, spark).count()
    assert (get("a"), get("a"), get("b"), get("a")) == (1, 1, 2, 1)


def test_envelopes_go_on_from_an_offset(spark):
    bins = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "bin long, peak long")
    assert [r.bin for r in live.envelope_since(bins, 2).collect()] == [1, 2] and live.envelope_since(bins, 0).count() == 3


def test_english_words_may_not_be_replaced(spark):
    from parlance.operators import guardrails

    df = spark.createDataFrame(
        [("mera phone gum gaya", "mera mobile gum gaya"), ("mera phone gum gaya", "mera phone gum gaya hai")],
        "s string, t string",
    )
    reasons = [r[0] for r in df.select(guardrails.revert_reason(F.col("s"), F.col("t"), loanwords=["phone", "mobile"])).collect()]
    assert reasons == ["replaced", None]


def test_a_recording_arrives_in_chunks(spark, tmp_path):
    from parlance.functions import signals
    from parlance.streaming import source

    ship_package(spark)
    sound = 0.5 * np.sin(np.arange(40_000) * 0.05)
    (tmp_path / "r.wav").write_bytes(writers.wav_bytes(sound))
    source.register(spark)
    stream = spark.readStream.format("recording").option("path", str(tmp_path / "r.wav")).option("seconds", "1").load()
    query = stream.writeStream.format("memory").queryName("chunks").outputMode("append").start()
    for _ in range(60):
        query.processAllAvailable()
        if spark.table("chunks").count() >= 3:
            break
    query.stop()
    got = spark.table("chunks").orderBy("chunk").collect()
    assert [(r.chunk, r.at, len(r.samples)) for r in got] == [(0, 0.0, 16_000), (1, 1.0, 16_000), (2, 2.0, 8000)]
    assert np.allclose(np.concatenate([r.samples for r in got]), sound, atol=1e-3) and signals.RATE == 16_000


def test_mel_filters_have_equal_areas():
    from parlance.functions import signals

    bank = signals._mel_bank()
    assert bank.shape == (48, 513) and signals._mel(np.array([0, 1000, 6400])).tolist() == [0, 15, 42]
    wide = bank[bank.shape[0] // 2 :]  # wide enough for the bins to sum their area
    assert np.allclose(wide.sum(1) * signals.RATE / 1024, 1, atol=0.1)


def test_the_page_reads_a_live_session(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from parlance.streaming import api

    bins = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "bin long, peak long")
    session = api.Session(spark, f"file://{tmp_path}/out", lambda: bins)
    served = api.server(session)
    threading.Thread(target=served.serve_forever, daemon=True).start()

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{served.server_port}{path}", data), timeout=60) as reply:
                return reply.status, json.load(reply)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    assert call("/api/result") == (200, []) and call("/api/state")[1]["result_version"] is None
    assert call("/api/start", {}) == (200, {"take": 2}) and call("/api/options", {"language": "ta", "other": 1})[0] == 200
    spark.createDataFrame([("S1", 3)], "speaker string, turns long").write.parquet(f"file://{tmp_path}/out/version=4")
    _, state = call("/api/state?take=2&env_from=2")
    assert (
        state["recording"],
        state["language"],
        state["result_version"],
        state["env_from"],
        state["env"],
    ) == (True, "ta", 4, 1, [6, 7]) and "other" not in state
    assert call("/api/state?take=1&env_from=2")[1]["env"] == [5, 6, 7]  # of another take: all of it
    assert call("/api/result") == (200, [{"speaker": "S1", "turns": 3}])
    assert call("/api/stop", {})[0] == 200 and not call("/api/state")[1]["recording"]
    assert call("/api/nothing", {})[0] == 404 and call("/nowhere")[0] == 404 and call("/api/state?take=x")[0] == 400
    served.shutdown()
    served.server_close()


def test_outputs_are_scored_against_their_sources(spark):
    from parlance.operators import separation

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 400))
    rows = [
        ("p", "hpss", (a + 0.1 * b).tolist(), (b + 0.1 * a).tolist(), True),
        ("p", "net", b.tolist(), (3 * a + 0.3 * b).tolist(), False),
        ("p", "wrong", b.tolist(), a.tolist(), True),
    ]
    df = spark.createDataFrame(
        [(*r[:4], a.tolist(), b.tolist(), r[4]) for r in rows],
        "id string, name string, out0 array<double>, out1 array<double>, ref0 array<double>, ref1 array<double>, fixed boolean",
    )
    got = {r.name: r for r in separation.output_table(df, ["id"]).collect()}
    assert abs(got["hpss"].first_db - 20) < 1 and abs(got["hpss"].second_db - 20) < 1 and not got["hpss"].swapped
    assert got["net"].swapped and abs(got["net"].first_db - 20) < 1 and got["net"].second_db > 60
    assert got["wrong"].first_db < 0 and not got["wrong"].swapped


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    from parlance import runtime

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(name, default):
                return default

    assert runtime.shared_folder(spark)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Cluster)


def test_only_what_may_compose_is_composed(spark):
    import unicodedata

    from parlance.functions import transliterate

    ship_package(spark)
    texts = ["plain", "é", "क़ा", "क़", "각", "가", "Å", "ü", None, "ொ", "ạ̇"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.text for r in transliterate.composed(df, "text").collect()}
    assert got == {k: None if t is None else unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}
    # No character outside the class changes anything before or after it.
    odd = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", transliterate._composing()))
    quiet = [chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000 and not odd.match(chr(k))]
    assert all(
        unicodedata.normalize("NFC", c) == c and unicodedata.normalize(
            "NFC",
            "e" + c,
        ) == "e" + c and unicodedata.normalize("NFC", "ক" + c) == "ক" + c for c in quiet
    )


def test_hysteresis_of_scores(spark):
    """Against a walk over the frames; a missing frame ends a stretch, a null score changes nothing."""
    from parlance.operators import intervals

    rng = np.random.default_rng(4)
    rows = [(rec, k, None if rng.random() < 0.05 else float(rng.random())) for rec in "abc" for k in range(200) if rec != "b" or k % 37]

    def walk(own):
        on, last, spans = False, None, []
        for k, x in own:
            if last is not None and k != last + 1:
                on = False
            on = on if x is None else True if x >= 0.7 else False if x < 0.3 else on
            if on:
                if spans and k - spans[-1][1] < 3:
                    spans[-1][1] = k + 1
                else:
                    spans.append([k, k + 1])
            last = k
        return [tuple(s) for s in spans if s[1] - s[0] >= 4]

    df = spark.createDataFrame(rows, "rec string, frame int, score double").repartition(3)
    got = intervals.hysteresis(df, ["rec"], on=0.7, off=0.3, least_on=4, least_off=3).collect()
    for rec in "abc":
        assert sorted((r.start, r.end) for r in got if r.rec == rec) == walk([(k, x) for i, k, x in rows if i == rec])


def test_joint_streams_hold_no_leaks(spark):
    from parlance.plans import registry

    rows = registry.QUERIES["joint_streams"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault((r.rec, r.frame), []).append(r)
    assert rows and all(len({r.speaker for r in own}) == len(own) and min(r.power for r in own) * 4 >= max(r.power for r in own) for own in by.values())
