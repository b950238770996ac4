import hashlib
import re

from parlance.llm import exact_duplicates as ed, mixing

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_duplicates_against_brute_force(table):
    long = "ab c" * 4000
    rows = [
        (1, None),
        (2, ""),
        (3, " "),
        (4, "a b"),
        (5, "ab"),
        (6, "a  b"),
        (7, "a  b"),
        (8, long),
        (9, long.replace(" ", "")),
        (10, long[:-1] + "d"),
        (11, long),
        (11, long),
        (None, "ab"),
        (12, "é\u00a0x"),
    ]
    for block in (3, 64, 2048):
        got = sorted(
            ((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.kept) for r in ed.exact_duplicates(table(rows), block_bytes=block).collect()),
            key=str,
        )
        groups = {}
        for i, t in rows:
            groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i))
        want = []
        for body, members in groups.items():
            keep = min(m for m in members if m[0] == min(x[0] for x in members))
            for m in members:
                want.append((m[2], keep[2], len(members), hashlib.sha256(body.encode()).hexdigest(), m == keep))
        # Of two rows alike in everything one stays.
        assert [x[:4] for x in got] == [x[:4] for x in sorted(want, key=str)]
        assert sum(x[4] for x in got) == len(groups)
        assert {x[0] for x in got if x[4]} == {min(m)[2] for m in groups.values()}
    assert ed.exact_duplicates(table([])).collect() == []


def test_wide_numbers_name_alike(spark, table):
    """Decimals, used where 63 bits do not number all blocks, give the same groups."""
    from pyspark.sql import functions as F

    from parlance.llm.scratch import Scratch

    rows = [(k, t) for k, t in enumerate(["ab" * 50, "ab" * 50, "ab" * 49 + "ac", "", "x", "x", "ab" * 25] * 30)]
    texts = Scratch(spark, "t").save(
        table(rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("body")),
        "rows",
    )
    groups = []
    for wide in (False, True):
        named = ed.identities(texts.select("row", "body"), Scratch(spark, "t"), block_bytes=16, wide=wide)
        found = {}
        for r in named.join(texts, "row").collect():
            found.setdefault((r.blocks, r.name), set()).add(r.doc_id)
        groups.append(sorted(map(sorted, found.values())))
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    assert groups[0] == groups[1] == sorted(want.values())


def waterfill(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """Reshare the excess by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, list(names)
    while True:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > limit * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: limit * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]


def mixed(table, rows, **options):
    return {r.doc_id: r for r in mixing.taken_words(*mixing.mix_sources(table(rows), **options)).collect()}


def test_mixing_targets_limits_and_reruns(table):
    rows = [(i, "w " * (i % 50), f"s{i % 7}" if i % 11 else None) for i in range(600)]
    got = mixed(table, rows, block_words=8)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goal = waterfill(sizes)
    taken = {}
    for i, t, s in rows:
        r = got[i]
        assert (r.size, r.source_size) == (len(t.split()), sizes[s]) and abs(r.target - goal[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.05 * goal[s] + 16
    again = mixed(table, rows, block_words=8)
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in got.items()}


def test_mixing_edges(table):
    got = mixed(table, [(1, None, "a"), (2, "", "b"), (3, " ", None)])
    assert [(got[i].size, got[i].target, got[i].taken) for i in (1, 2, 3)] == [(0, 0.0, 0)] * 3
    assert mixed(table, []) == {}
    assert mixed(table, [(1, "a b c", "x")])[1].taken in (4, 5)  # the target is 4.5
    tiny = mixed(table, [(1, "a " * 900, "a"), (2, "b c", "b"), (3, "d", None)])
    assert (tiny[2].target, tiny[2].taken, tiny[3].target, tiny[3].taken) == (4, 4, 2, 2)  # sources at their limit give all
    assert abs(tiny[1].taken - tiny[1].target) <= 900 / 64


def test_mixing_repeated_rows_null_ids_and_long_texts(table):
    rows = [(1, "a b c", "x")] * 5 + [(None, "d e", "x")] * 3 + [(7, "w " * 500_000, "y"), (7, "w " * 500_000, "y"), (8, "v " * 3, "y")]
    got = [(r.doc_id, r.size, r.target, r.taken) for r in mixing.taken_words(*mixing.mix_sources(table(rows))).collect()]
    assert sorted((i, n) for i, n, _, _ in got if i is not None) == sorted(
        (i, len(t.split())) for i, t, _ in rows if i is not None
    ) and sum(i is None for i, *_ in got) == 3
    assert all(0 <= taken <= 2 * n for _, n, _, taken in got)
    assert sum(t for i, _, _, t in got if i in (1, None)) == 2 * 21  # at its limit
    long = [t for i, _, _, t in got if i in (7, 8)]
    assert abs(sum(long) - (1.5 * 1_000_024 - 42)) <= 64
    texts = mixing.mixed_texts(table(rows)).collect()
    assert abs(sum(len(r.text.split()) for r in texts) - 1.5 * 1_000_024) <= 1024


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mixed_texts_are_pieces(table):
    rows = [(i, f"  start {i} " + "word  and\nline " * (5 * i), "a" if i % 3 else "b") for i in range(20)] + [(99, None, "a")]
    by_id = dict((i, t) for i, t, _ in rows)
    out = mixing.mixed_texts(table(rows), block_words=16)
    assert out.columns == table(rows).columns
    found = out.collect()
    assert found and all(r.text in by_id[r.doc_id] and r.n_chars == len(r.text) for r in found)
    for i in by_id:  # no document more than twice
        assert sum(len(r.text.split()) for r in found if r.doc_id == i) <= 2 * len((by_id[i] or "").split())
    assert mixing.mixed_texts(table([])).collect() == []
