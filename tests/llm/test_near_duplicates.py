import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import components, near_duplicates as nd
from parlance.llm.scratch import Scratch


def brute(rows, words, percent=80):
    """component_id of each doc_id by comparing all sets of word tuples."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups, copies, length=60):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [4, 5])
def test_against_brute_force(table, words):
    rows = near_copies(words, 12, 15)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(table(rows), words=words).collect()}
    assert got == brute(rows, words)


def test_one_large_group_needs_no_pair_list(table):
    rows = near_copies(3, 1, 700, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(table(rows), words=4).collect()}
    assert got == brute(rows, 4)


def test_edges(table):
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t"),
        (4, "one"),
        (5, "ONE"),
        (6, "one two"),
        (7, "one  two\n"),
        (8, "a b c d e f"),
        (8, "a b c d e f"),
        (9, "A B C D E F"),
        (None, "a b c d e f"),
        (10, "x " * 30_000),
    ]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(table(rows), words=4).collect()]
    assert sorted((x for x in got if x[0] is not None)) == [
        (1, 0, 1, True),
        (2, 0, 2, True),
        (3, 0, 3, True),
        (4, 1, 4, True),
        (5, 1, 4, False),
        (6, 1, 6, True),
        (7, 1, 6, False),
        (8, 3, 8, True),
        (8, 3, 8, True),
        (9, 3, 8, False),
        (10, 1, 10, True),
    ]
    assert [x for x in got if x[0] is None] == [(None, 3, None, False)]


def test_empty_table(table):
    assert nd.near_duplicates(table([])).collect() == []


def test_stage_keeps_one_row_of_each_group(table):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "q r s t u v"), (None, None), (None, None)]
    kept = nd.drop_near_duplicates(table(rows))
    assert kept.columns == table([]).columns
    assert sorted(str(r.text).lower() for r in kept.collect()) == ["a b c d e f g", "none", "none", "q r s t u v"]


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(1)
    for size in (40, 1000, 20_000):
        for share in (0.3, 0.6, 0.9):
            common = rng.integers(0, 2**64, int(size * share), np.uint64)
            a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**64, size - len(common), np.uint64)))) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got = nd.estimate_jaccard(nd.sketch(a)[None], nd.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(got - true) < 0.16


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = dict(connected(edges, spark))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def connected(edges, spark):
    return [(r.node, r.root) for r in components.connected_components(edges, Scratch(spark, "test"), "c").collect()]


def test_repeated_ids_of_different_texts(table):
    """Rows are linked by their texts, not by a shared id."""
    a, b = "a b c d e f g h", "q r s t u v w x"
    got = sorted((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(table([(3, a), (7, a), (7, b), (9, b), (9, b)]), words=4).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False), (9, 7, False)]


def test_text_ids(spark):
    rows = [("x1", "a b c d e f g h"), ("b", "A b c d e f g h"), ("z", "other words are here now"), (None, "a b c d e f g h")]
    got = {
        (r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), words=4).collect()
    }
    assert got == {("x1", "b", False), ("b", "b", True), ("z", "z", True), (None, None, False)}


def templates(seed, count, length=150, kept=0.8):
    """Texts that share a template: all share bands, few are links."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(length)]
    rows = []
    while len(rows) < count:
        text = [w if rng.random() < kept ** 0.25 else f"x{rng.randrange(10**6)}" for w in base]
        for _ in range(rng.choice((1, 1, 1, 2))):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[rng.randrange(length)] = f"y{rng.randrange(10**6)}"
    return rows[:count]


@pytest.mark.parametrize("huge", [8, nd._HUGE])
def test_template_buckets_are_searched(table, huge):
    """Also where buckets are split by rare shingles."""
    rows = templates(5, 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(table(rows), words=4, huge=huge).collect()}
    assert got == brute(rows, 4)


def test_rare_shingles_lose_no_pair_and_split_templates(spark, monkeypatch):
    """Every pair at the threshold of one bucket meets in a part, a smaller set as first one; sets of one template do not meet."""
    rng = np.random.default_rng(8)
    frame = [f"t{k}" for k in range(85)]
    sets = [[*frame, *(f"own{k}_{j}" for j in range(15))] for k in range(40)]  # unlinked: 0.74 in common
    for k in range(60):  # linked to one of them or to each other
        base = list(sets[rng.integers(len(sets))])
        for at in rng.choice(len(base), rng.integers(0, 12), replace=False):
            base[at] = f"new{k}_{at}"
        sets.append(base[: len(base) - rng.integers(0, 12)])
    texts = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(sets)], "rep long, text string")
    large = spark.createDataFrame([(9, k, len(x), 100 + len(sets), 1000 + k) for k, x in enumerate(sets)], "key long, rep long, n int, m int, root long")
    parts = {}
    for r in nd._by_rare_shingles(large, texts, 1, 0.8).collect():
        parts.setdefault(r.key, []).append(r)
        assert r.m >= r.first_m > 0
    met = {(a.rep, b.rep) for rows in parts.values() for a in rows if a.first for b in rows}
    close = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and len(sets[i]) <= len(sets[j]) and 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})]
    assert close and all((i, j) in met or (j, i) in met for i, j in close) and all((i, j) in met for i, j in close if len(sets[i]) < len(sets[j]))
    plain = large.where("rep < 40")
    assert nd._by_rare_shingles(plain, texts, 1, 0.8).count() == 0


def test_pivots_head_each_part_of_their_pairs(spark):
    pairs = spark.createDataFrame([(1, b) for b in range(2, 2000)] + [(5000, 5001)], "a long, b long")
    own = spark.range(6000).select(F.col("id").alias("rep"), (F.col("id") * 10).alias("v"))
    seen, heads = set(), 0
    for part in nd.by_pivot(pairs, own, ["v"]).rdd.glom().collect():
        head = None
        for r in part:
            if r.b is None:
                head, heads = r, heads + 1
                assert r.v == 10 * r.a
            else:
                assert head.a == r.a and r.v == 10 * r.b
                seen.add((r.a, r.b))
    assert seen == {tuple(r) for r in pairs.collect()} and 5 < heads < 30


@pytest.mark.parametrize("size", [5, 30, 65, 250, 1500])
def test_links_at_the_threshold_share_a_band_and_pass_the_estimate(size):
    """Sets at a similarity of just 0.8: none of 400 pairs is lost."""
    rng = np.random.default_rng(size)
    margin = 6 * (0.16 / nd.REGISTERS) ** 0.5
    for _ in range(400):
        rest = max(1, round(size / 9)) if size > 5 else 1
        common = rng.integers(0, 2**64, 8 * rest, np.uint64)
        a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**64, rest, np.uint64)))) for _ in range(2))
        x, y = nd.sketch(a), nd.sketch(b)
        used = nd.BANDS * nd.BAND_ROWS
        assert (x[:used] == y[:used]).reshape(nd.BANDS, -1).all(1).any()
        assert min(len(a), len(b)) <= nd._SMALL or nd.estimate_jaccard(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0] >= 0.8 - margin
