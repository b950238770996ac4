import corpus_pipeline as cp
from parlance.llm import decontaminate, packing, tokens

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    counts = [kept.count()]
    for name, stage in cp.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == columns, name
        counts.append(kept.count())
        if name == "benchmark decontamination":
            assert {r.n_hit for r in decontaminate.find_contamination(kept, bench).collect()} == {0}
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    packed = cp.STAGES[-1][1](spark, kept, SF).collect()
    want = sum(len(tokens.encode(r.text)) + 1 for r in kept.collect())
    assert sum(r.n_tokens for r in packed) == want
    assert all(len(r.ids) == 4096 for r in packed) and packing.positions(packed[0].cu_seqlens, 2048)[0] == 0


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)
    for table in (docs.limit(0), odd):
        kept = table
        for _, stage in cp.STAGES:
            kept = stage(spark, kept, SF)
        kept.collect()
