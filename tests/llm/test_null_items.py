"""Test items without an id are searched like the others."""

import pytest

from parlance.llm import decontaminate


@pytest.mark.parametrize("block_chars", [16_000_000, 1])
def test_items_without_id_are_searched(spark, table, block_chars):
    docs = table([(1, "x one two three y"), (2, "four five"), (3, "clean")])
    bench = spark.createDataFrame([(None, "one two three"), ("b", "four five")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, bench, block_chars=block_chars).collect()}
    assert got == {1: (5, 3, []), 2: (2, 2, ["b"]), 3: (1, 0, [])}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench, block_chars=block_chars).collect()] == [3]
