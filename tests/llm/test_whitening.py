import numpy as np
import pytest

from parlance.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n double"


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(k, v, 1, "x", 0.5) for k, v in rows], SCHEMA).repartition(3)

    return make


def plain(rows):
    """Eigenvectors of the covariance of the distinct integer vectors, in one matrix."""
    x = {k: np.floor(np.array(v, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000 for k, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - 1_000_000 - (s - n * 1_000_000) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, e[::-1], v[:, ::-1]


def held(got, rows, components=16):
    x, n, s, e, v = plain(rows)
    for r in got:
        i = r.component - 1
        z = n * x[r.vec_id] - s
        want = float((z / n) @ v[:, i] / np.sqrt(e[i]))
        assert r.n == n and r.deviation == int((z.astype(object) ** 2).sum())
        assert abs(abs(r.whitened) - abs(want)) < 1e-7 * max(1, abs(want))
        assert abs(r.explained - e[i] / e.sum()) < 1e-9 and r.identity_error < 1e-9
    assert sorted((r.vec_id, r.component) for r in got) == sorted((k, c) for k, _ in rows for c in range(1, components + 1))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(np.sign(r.whitened * ((n * x[r.vec_id] - s) @ v[:, r.component - 1])))
    assert all(abs(sum(signs)) == len(signs) for signs in by.values())  # one sign of a component for all rows


def test_whole_table_against_eigenvectors(spark):
    embeddings = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    held(whitening.whiten(embeddings.repartition(7)).collect(), rows)


def test_repeated_vectors_count_once(spark, table):
    rng = np.random.default_rng(1)
    base = [(k, [float(c) for c in rng.normal(size=5) * [5, 3, 2, 1, 0.5]]) for k in range(40)]
    rows = base + [(100 + k, base[0][1]) for k in range(60)]
    held(whitening.whiten(table(rows)).collect(), rows, components=5)


def test_merging_is_lossless():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(300, 12)) * 64 * np.logspace(0, -2, 12)).astype(np.int64) + 1_000_000
    x[:100] += 500  # blocks of very different means
    state = None
    for part in (x[:100], x[100:101], x[101:300]):
        state = whitening.merge(state, whitening.factor_of(part))
    centred = x - x.mean(0)
    assert state.n == 300 and state.sums == x.sum(0).tolist() and state.factor.shape == (12, 12)
    assert np.allclose(state.factor.T @ state.factor, centred.T @ centred, rtol=1e-12)


def test_any_tree_gives_the_same(spark):
    embeddings = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, many = (
        {(r.vec_id, r.component): r.whitened for r in whitening.whiten(embeddings.repartition(p), components=4).collect()} for p in (1, 37)
    )
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-9


def test_odd_vectors_and_tables(spark, table):
    good = [(1, [0.0, 1.0]), (2, [1.0, 0.5]), (None, [2.0, 3.0]), (2, [1.0, 0.5])]
    odd = [(3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, [1.0, 2.0, 3.0])]
    got = whitening.whiten(table(good + odd)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((k, c) for k in ("1", "2", "2", "None") for c in (1, 2))
    assert {r.n for r in got} == {3}
    assert whitening.whiten(table(odd[:5])).collect() == [] and whitening.whiten(table([])).collect() == []
    assert whitening.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance
    line = whitening.whiten(table([(k, [float(k), 2.0 * k]) for k in range(5)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    huge = whitening.whiten(table([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id in (1, 2)} == {None}
