"""The whole pipeline on a small folder, stage by stage against plain versions, and on very long texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from parlance.llm import packing, quality, tokens
from test_decontaminate import brute as contamination
from test_duplicates_and_mixing import waterfill
from test_long_and_odd import plain_score

SOURCE = "/root/testdata/sf0.001"


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def without_near_copies(rows):
    """One row of each component of links at a similarity of 0.8 or more; rows without words all stay."""
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [[r for k, r in enumerate(rows) if find(k) == c] for c in range(len(rows)) if find(c) == c]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    # Some rows twice, one without an id, one without text.
    some = docs.where("doc_id < 150")
    odd = some.limit(3).unionByName(some.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(
        some.limit(1).withColumn("text", F.lit(None).cast("string"))
    )
    some.unionByName(odd).repartition(3).write.parquet(f"file://{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").write.parquet(f"file://{root}/{name}.parquet")
    return f"file://{root}"


def test_run_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(quality.learnable())
    model = quality.fit(quality.training_rows(docs, labels))
    good = [r for r in docs.collect() if (plain_score(r.text, model) if model.weights else 0.5) >= 0.5]
    groups = without_near_copies(good)
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [[r for r, (_, hit, _) in zip(g, contamination([x.text for x in g], bench), strict=True) if not hit] for g in groups]

    kept = docs
    for k, (_, stage) in enumerate(cp.STAGES[:3]):
        kept = spark.createDataFrame(stage(spark, kept, folder).collect(), docs.schema)
        if k == 1:
            texts = Counter(r.text for r in kept.collect())
            # Of each group one row stays; which of its rows is free.
            assert sum(texts.values()) == len(groups)
            left = [{r.text for r in g} for g in groups]
            assert all(sum(texts[t] for t in g) >= 1 for g in left)
    rows = kept.collect()
    assert all(any((r.doc_id, r.text) == (x.doc_id, x.text) for g in clean for x in g) for r in rows)
    assert sum(bool(g) for g in clean) >= len(rows) >= sum(len(g) == len(w) > 0 for g, w in zip(clean, groups, strict=True))

    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").split())
    goal = waterfill(dict(size))
    mixed = cp.STAGES[3][1](spark, kept, folder)
    pieces = mixed.collect()
    taken, whole = Counter(), {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r.text or "")
    for p in pieces:
        taken[p.source] += len(p.text.split())
        assert any(p.text in t for t in whole[p.doc_id])
    assert all(abs(taken[s] - goal[s]) <= max(2 * size[s] / 64, 512) for s in size)

    again = spark.createDataFrame(pieces, docs.schema)
    packed = packing.unpack([r.asDict() for r in cp.STAGES[4][1](spark, again, folder).collect()])
    assert Counter((d, tuple(ids.tolist())) for d, ids in packed.values()) == Counter(
        (p.doc_id, tuple(tokens.encode(p.text).tolist())) for p in pieces
    )
    # run() is these stages, one after the other.
    assert sum(r.n_tokens for r in cp.run(spark, folder).collect()) == sum(len(tokens.encode(p.text)) + 1 for p in pieces)


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" * 2_000_000, "7" * 2_000_000, "x y " * 500_000, "\né" * 1_000_000], ids=lambda t: repr(t[:4]))
def test_very_long_texts_pass_every_stage(spark, folder, text):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5")
    long = spark.createDataFrame([(900, text, "en", "s", len(text)), (901, text + " end", None, None, None)], docs.schema)
    kept = docs.unionByName(long)
    for _, stage in cp.STAGES[1:]:
        kept = stage(spark, kept, folder)
    assert kept.count() > 0
