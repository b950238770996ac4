"""Distances and alignments against tables of all cells, and diarization errors of many speakers against permutations."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from parlance.operators import alignment, assignment


def table(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d


def met(a, b):
    """The way back through the whole table: diagonal first, then a deletion."""
    d, out, i, j = table(a, b), [False] * len(a), len(a), len(b)
    while i and j:
        if d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out[i] = a[i] == b[j]
        elif d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def pairs(count, longest, seed):
    rng = random.Random(seed)
    for _ in range(count):
        k = rng.choice([1, 2, 3, 9])
        yield tuple([rng.randrange(k) for _ in range(rng.randrange(longest))] for _ in range(2))


def test_distance_by_strips():
    for a, b in pairs(400, 25, 1):
        for strip in (1, 3, 8, 64):
            assert alignment.distance(a, b, strip=strip) == table(a, b)[-1][-1], (a, b, strip)
    assert alignment.distance("kitten", "sitting") == 3 and alignment.distance([], []) == 0


def test_matched_tokens_with_ties():
    for a, b in pairs(400, 25, 2):
        for held in (1, 10, 50, 1 << 20):
            assert alignment.matched_tokens(a, b, held=held) == met(a, b), (a, b, held)
    assert alignment.matched_tokens(["a", "b", "c"], ["a", "c"]) == [True, False, True]
    assert alignment.matched_tokens([], ["x"]) == [] and alignment.matched_tokens(["x"], []) == [False]


def test_hours_long_texts():
    rng = random.Random(3)
    ref = [rng.randrange(20_000) for _ in range(100_000)]
    hyp = [w for w in ref if rng.random() > 0.1]
    began = time.time()
    assert alignment.distance(ref, hyp) == len(ref) - len(hyp)
    assert time.time() - began < 60
    # Of a text with words left out only, least edits meet every word that is left.
    assert sum(alignment.matched_tokens(ref[:8000], [w for w in ref[:8000] if w % 9], held=1 << 16)) == sum(w % 9 > 0 for w in ref[:8000])


def test_edits_in_the_jvm_and_beyond(spark, monkeypatch):
    from parlance.runtime import ship_package

    ship_package(spark)
    rows = [([f"w{x}" for x in a], [f"w{x}" for x in b]) for a, b in pairs(60, 30, 4)] + [([], []), ([], ["x"])]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>").repartition(3)
    for cells in (alignment.CELLS, 100, -1):
        monkeypatch.setattr(alignment, "CELLS", cells)
        for unit, form in (("word", list), ("char", "".join)):
            got = df.select("r", "h", alignment.edits(F.col("r"), F.col("h"), unit).alias("e")).collect()
            assert all(x.e == table(form(x.r), form(x.h))[-1][-1] for x in got) and len(got) == len(rows)


def test_nulls_have_no_distance(spark):
    row = spark.sql("select cast(null as array<string>) r, array('a') h").select(alignment.edits(F.col("r"), F.col("h")).alias("e")).first()
    assert row.e is None


def test_many_speakers_against_permutations(spark):
    """Confusion and shared time of nine labels a side, where the third and later ones count, too."""
    rng = random.Random(7)
    k = "rec_id string, label string, start long, end long"
    sides = []
    for side in range(2):
        rows = []
        for rec, label in itertools.product("ab", range(6 if side else 5)):
            at = 0
            for _ in range(8):
                at += rng.randrange(1, 400)
                rows.append((rec, f"L{label}", at, at := at + rng.randrange(1, 300)))
        sides.append(rows)
    ref, hyp = (spark.createDataFrame(rows, k) for rows in sides)
    got = {r.rec_id: r.matched for r in assignment.der_parts(ref, hyp, ["rec_id"]).collect()}
    shares = {(r.rec_id, r.label): (r.own, r.other, r.shared) for r in assignment.jaccard_parts(ref, hyp, ["rec_id"]).collect()}
    for rec in "ab":
        times = [[{t for r, x, s, e in side if (r, x) == (rec, f"L{i}") for t in range(s, e)} for i in range(6)] for side in sides]
        both = [[len(x & y) for y in times[1]] for x in times[0]]
        best = max(itertools.permutations(range(6)), key=lambda p: sum(both[i][p[i]] for i in range(6)))
        assert got[rec] == sum(both[i][best[i]] for i in range(6))
        assert sum(shares[rec, f"L{i}"][2] for i in range(5)) == got[rec]
        assert all(shares[rec, f"L{i}"][0] == len(times[0][i]) for i in range(5))


def test_labels_that_never_meet(spark):
    k = "rec_id string, label int, start long, end long"
    ref, hyp = spark.createDataFrame([("a", 0, 0, 10), ("a", 7, 10, 20)], k), spark.createDataFrame([("a", 3, 0, 10)], k)
    row = assignment.der_parts(ref, hyp, ["rec_id"]).first()
    assert (row.total, row.missed, row.false_alarm, row.paired, row.matched) == (20, 10, 0, 10, 10)
    got = {r.label: (r.own, r.other, r.shared) for r in assignment.jaccard_parts(ref, hyp, ["rec_id"]).collect()}
    assert got == {"0": (10, 10, 10), "7": (10, 0, 0)}
    assert assignment.der_parts(ref, hyp.limit(0), ["rec_id"]).first().matched == 0


@pytest.mark.parametrize("n", [2, 5])
def test_equal_costs_take_the_first_order(spark, n):
    rows = [("a", f"r{i}", f"h{j}", 5) for i in range(n) for j in range(n)]
    got = assignment.assign_costs(spark.createDataFrame(rows, "id string, ref string, hyp string, cost long"), ["id"]).collect()
    assert {(r.ref, r.hyp) for r in got} == {(f"r{i}", f"h{i}") for i in range(n)}
