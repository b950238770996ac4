"""Queries against their SQL on rows that only larger tables hold."""

import datetime as dt

import duckdb

from parlance.operators import intervals as iv
from parlance.plans import registry


def differences(spark, folder, name, table, rows, schema):
    """Rows that the query and its SQL do not share, on one small table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    got = registry.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert want
    return sorted(map(tuple, got.collect())), sorted(want)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_action_names_a_question_word(spark, tmp_path):
    rows = [(c, 3, "user", f"{w} red boxes came") for c, w in enumerate(("when", "where", "why", "who", "whom", "how", "boxes"))]
    got, want = differences(spark, tmp_path, "action_validation", "conversations", rows, CONVERSATIONS)
    assert got == want


def test_action_of_a_conversation_of_a_thousand_turns(spark, tmp_path):
    rows = [(1, t, "user", f"boxes{t} came") for t in range(1001)]
    got, want = differences(spark, tmp_path, "action_validation", "conversations", rows, CONVERSATIONS)
    assert got == want


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_turns_of_exactly_ten_minutes_are_not_long(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(milliseconds=ms), 8 * i, "view", v) for i, (ms, v) in enumerate(((429707, 30.0), (432698, 30.0), (80000001, 30.0), (5, 30.1)))]
    got, want = differences(spark, tmp_path, "result_bundle", "events", rows, EVENTS)
    assert got == want


def test_turns_sharing_a_minute(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    turns = [(0, 0, 3.0), (1, 8, 3.0), (2, 16, 2.99995), (3, 8, 200.0), (4, 16, 182.99995), (5, 0, 0.5)]
    rows = [(i, day + dt.timedelta(seconds=10 * (i // 3)), u, "view", v) for i, u, v in turns]
    got, want = differences(spark, tmp_path, "overlap_pairs", "events", rows, EVENTS)
    assert got == want


def test_what_is_too_short_for_a_pair_is_not_spread(spark):
    spans = [(0, 60), (1, 60), (0, 59), (59, 119), (100, 160), (30, 400), (341, 401)]
    t = spark.createDataFrame([("r", i, s, e) for i, (s, e) in enumerate(spans)], "rec_id string, seq long, start long, end long")
    pairs = iv.sharing(t, t, ["rec_id"], 50, 60)
    got = sorted((r.seq_a, r.seq_b, r.shared) for r in pairs.collect())
    shared = lambda a, b: min(a[1], b[1]) - max(a[0], b[0])
    assert got == sorted((i, j, shared(a, b)) for i, a in enumerate(spans) for j, b in enumerate(spans) if shared(a, b) >= 60)
    assert not {1, 2} & {i for i, _, _ in got}


def test_a_large_table_is_shared_out_over_more_tasks(spark, tmp_path):
    long = "id % 500 = 0"
    spark.range(900_000).selectExpr(
        "id as event_id",
        "cast(timestamp_micros(1704067200000000 + (id % 300) * 86400000000 + cast(rand(1) * 86400000000 as long)) as timestamp_ntz) as ts",
        "cast(rand(2) * 1000000000 as long) as user_id",
        "'view' as event_type",
        f"if({long}, 900, 2) * rand(3) as value",
    ).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["overlap_pairs"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES['overlap_pairs']})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    # As many as the bytes ask for, though so few turns are long enough for a pair that they would fill one.
    assert got.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
