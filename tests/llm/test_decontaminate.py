import re

from hypothesis import given, settings, strategies as st

from parlance.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


texts = st.lists(st.sampled_from(["a", "b", "A", "é", "-", " ", "\n", "ab", "1", "ü "]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts | st.none(), max_size=5), st.lists(texts, max_size=4), st.integers(1, 4))
def test_scan_against_brute_force(docs, items, window):
    named = [(str(k), t) for k, t in enumerate(items)]
    assert list(dc.Index(named, window).scan(docs)) == brute(docs, named, window)


def test_corpus_and_blocks(spark, documents, corpus):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    want = dict(zip(corpus, brute(corpus.values(), items), strict=True))
    for chars in (16_000_000, 900):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in dc.find_contamination(documents, bench, block_chars=chars).collect()}
        assert got == want
    clean = {r.doc_id for r in dc.decontaminate(documents, bench, block_chars=900).collect()}
    assert clean == {i for i, w in want.items() if not w[1]}


def test_one_block_of_items_is_held_at_a_time(spark, table, monkeypatch):
    """Each item a block: the next block's tables are built when the last ones are gone, with equal results."""
    bench = spark.createDataFrame([(k, f"item{k} and its own words number {k}") for k in range(6)], "item_id long, text string")
    rows = [(k, f"x item{k} and its own words number {k} y" if k % 2 else f"plain text {k}") for k in range(12)]
    live, most, context = set(), [], spark.sparkContext
    make = context.broadcast

    def broadcast(value):
        held = make(value)
        live.add(held)
        most.append(len(live))
        gone = held.destroy
        held.destroy = lambda *a: (live.discard(held), gone(*a))
        return held

    monkeypatch.setattr(context, "broadcast", broadcast)
    want = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in dc.find_contamination(table(rows), bench).collect()}
    live.clear(), most.clear()
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in dc.find_contamination(table(rows), bench, block_chars=1).collect()}
    assert got == want and [hit for _, hit, _ in want.values()].count(6) == 0 and set(most) == {1} and len(most) == 6
    live.clear(), most.clear()
    assert {r.doc_id for r in dc.decontaminate(table(rows), bench, block_chars=1).collect()} == {k for k, (_, hit, _) in want.items() if not hit}
    assert set(most) == {1} and len(most) == 6


def test_edges(spark, table):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (1, "one two"), (4, "Two")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "say ONE, two."), (3, "say ONE, two."), (None, "two"), (5, "three")]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in dc.find_contamination(table(rows), bench).collect()), key=str)
    assert got == sorted([(1, 0, 0, []), (2, 0, 0, []), (3, 3, 2, ["1", "4"]), (3, 3, 2, ["1", "4"]), (None, 1, 1, ["4"]), (5, 1, 0, [])], key=str)
    assert dc.decontaminate(table(rows), bench).columns == table(rows).columns
    assert dc.find_contamination(table([]), bench).collect() == []
    assert [r.n_hit for r in dc.find_contamination(table(rows), bench.limit(0)).collect()] == [0] * 6
