"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the test items. Texts and patterns become
integer sequences (a word that no item holds is 0). For each pattern length the
scan keeps a cursor per lane of text and looks up the block (word pair) that
ends at the cursor: the SHIFT table says how far the cursor may jump without
missing an occurrence, shift 0 leads to the suffix-hash bucket of that block,
and every window of the bucket is compared word by word. Cursors of all lanes
advance together in numpy, so the table look-ups are vectorised.

The tables of a block of items are built once, on the driver, and broadcast; a
Python worker reads them once for all its tasks. The items are read and searched
block by block, so neither driver nor executors hold more than one.

Edge cases: a null or empty text has no words and is not contaminated; an item
without words gives no window; an item shorter than the window is one window of
its own length; equal windows of several items count for each of them; an item
without an id is searched too, its words count as hit, and only the list of
items leaves it out; rows of one
item id count as one item; repeated documents give repeated rows; a very long
text is scanned whole, and white space or separators of any length cost linear
time; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.batches import slices
from parlance.llm.scratch import Scratch

#: Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_LANE = 512


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Shift and bucket tables for windows of one length over integer words."""

    def __init__(self, windows: np.ndarray, vocabulary: int) -> None:
        self.windows = windows  # (patterns, length), every word > 0
        self.length = windows.shape[1]
        self.block = min(2, self.length)
        self.base = np.int64(vocabulary + 1)
        self.far = self.length - self.block + 1
        # Keys by the least shift: how far their last place is from a window's end.
        ends = range(self.length - 1, self.block - 2, -1)
        keys = np.concatenate([self._keys(windows, end) for end in ends])
        shifts = np.repeat(self.length - 1 - np.array(ends), len(windows))
        self.keys, first = np.unique(keys, return_index=True)
        self.shifts = shifts[first]
        last = self._keys(windows, self.length - 1)
        order = np.argsort(last, kind="stable")
        self.bucket_rows = order
        self.bucket_lo = np.searchsorted(last[order], self.keys, "left")
        self.bucket_hi = np.searchsorted(last[order], self.keys, "right")

    def _keys(self, rows: np.ndarray, end: int) -> np.ndarray:
        key = rows[:, end].astype(np.int64)
        return key if self.block == 1 else rows[:, end - 1].astype(np.int64) * self.base + key

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends (index of the last word) and pattern rows of all occurrences in ``text``."""
        n, m = len(text), self.length
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        text = text.astype(np.int64)
        block = text.copy()
        if self.block == 2:
            block[1:] += text[:-1] * self.base
        cursor = np.arange(m - 1, n, _LANE, dtype=np.int64)
        stop = np.minimum(cursor + _LANE, n)
        ends, rows = [], []
        while len(cursor):
            at = np.searchsorted(self.keys, block[cursor])
            at[at == len(self.keys)] = 0
            known = self.keys[at] == block[cursor]
            shift = np.where(known, self.shifts[at], self.far)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                lo, hi = self.bucket_lo[at[hit]], self.bucket_hi[at[hit]]
                count = hi - lo
                where = np.repeat(cursor[hit], count)
                slot = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                pattern = self.bucket_rows[slot]
                same = np.ones(len(where), bool)
                for back in range(m):
                    left = np.flatnonzero(same)
                    if not len(left):
                        break
                    same[left] = text[where[left] - back] == self.windows[pattern[left], m - 1 - back]
                ends.append(where[same])
                rows.append(pattern[same])
            cursor = cursor + np.maximum(shift, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        return (np.concatenate(ends), np.concatenate(rows)) if ends else (none, none)


class Index:
    """All windows of a block of test items, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items if item is not None})
        place = {name: k for k, name in enumerate(self.names)}
        parts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)] for _, text in items]
        sizes = np.minimum(window, [len(p) for p in parts])
        self.searches = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = [k for k, s in enumerate(sizes.tolist()) if s == size]
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(parts[k], np.int32), size) for k in own])
            item = np.repeat([place.get(items[k][0], -1) for k in own], [len(parts[k]) - size + 1 for k in own])
            windows, of = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.column_stack((of.reshape(-1), item)), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]  # items without an id are found, but not named
            self.searches.append((WuManber(windows, len(self.vocabulary)), np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1]))

    def numbers(self, text: str | None) -> np.ndarray:
        """The words of a text as numbers; a word that no item holds is 0."""
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def hits(self, stream: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window length its size, the ends of its occurrences, and (occurrence, item) pairs."""
        for search, lo, item in self.searches:
            ends, rows = search.search(stream)
            count = lo[rows + 1] - lo[rows]
            at = np.repeat(lo[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield search.length, ends, np.repeat(np.arange(len(rows)), count), item[at]

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
        """(words, hit words, items) of each text, by one pass over their joined word sequence."""
        parts = [self.numbers(text) for text in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        # The 0 behind each text keeps windows inside it.
        stream = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int64))]) if parts else np.zeros(0, np.int64)
        starts = np.cumsum(counts + 1) - counts - 1
        edge = np.zeros(len(stream) + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for size, ends, of, item in self.hits(stream):
            np.add.at(edge, ends - size + 1, 1)
            np.add.at(edge, ends + 1, -1)
            docs = np.searchsorted(starts, ends[of], "right") - 1
            for doc, own in np.unique(np.column_stack((docs, item)), axis=0).tolist():
                items[doc].add(own)
        covered = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.cumsum(edge[:-1]) > 0)))
        for k in range(len(texts)):
            lo = int(starts[k])
            yield int(counts[k]), int(covered[lo + counts[k]] - covered[lo]), [self.names[i] for i in sorted(items.get(k, ()))]


def _items(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The test items in blocks of at most ``block_chars`` characters (or one item); without items one empty block."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if block and size + len(text or "") > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    yield block


def _one_by_one(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int, window: int, use) -> object:
    """``use(broadcast, number, last)`` for one block of items after the other, and what the last call gives.

    A table that the next block does not need is destroyed before that is built,
    so driver and executors hold one at a time, whatever the number of items.
    """
    context, blocks = benchmark.sparkSession.sparkContext, _items(benchmark, id_col, text_col, block_chars)
    block, number = next(blocks), 0
    while True:
        held, following = context.broadcast(Index(block, window)), next(blocks, None)
        made = use(held, number, following is None)
        if following is None:
            return made
        held.destroy()
        block, number = following, number + 1


_SCHEMA = "doc_id {}, n_words long, n_hit long, items array<string>"


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = 16_000_000,
) -> DataFrame:
    """One row per document: n_words, n_hit (words inside an occurrence of a window) and the items found.

    The items are a stated query set. They are searched in blocks of at most
    ``block_chars`` characters, each block's tables being broadcast; every block
    is matched against all documents. With one block nothing is shuffled. With
    more, rows are numbered and written once, each block's hit positions are
    written before the next block's tables are built, and those of a row, one
    list per block, are merged. A null doc_id is kept.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, row long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"
    scratch, rows, hits = Scratch(documents.sparkSession, "contamination"), [], []

    def search(held, number: int, last: bool) -> DataFrame:
        if last and not number:
            return source.mapInArrow(_scanner(held), _SCHEMA.format(kind))
        if not rows:
            rows.append(scratch.save(source.withColumn("row", F.monotonically_increasing_id()), "rows"))
        hits.append(scratch.save(rows[0].mapInArrow(_positions(held), schema), f"hits-{number}"))
        return reduce(DataFrame.unionByName, hits)

    every = _one_by_one(benchmark, item_id, item_text, block_chars, window, search)
    if not hits:
        return every
    merged = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(s["lo"] - 1, a["end"]))).alias("n"),
            F.greatest(a["end"], s["hi"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return merged.select("doc_id", "n_words", covered.alias("n_hit"), "items")


def _scanner(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = list(held.value.scan(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "n_hit", "items"],
            )

    return run


def _positions(held):
    """Hit runs of one block of items, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            spans, counts, names = [], [], []
            for text in part.column("text").to_pylist():
                stream = held.value.numbers(text)
                own, of = set(), set()
                for size, ends, _, item in held.value.hits(stream):
                    own.update(zip((ends - size + 1).tolist(), ends.tolist(), strict=True))
                    of.update(item.tolist())
                spans.append([{"lo": a, "hi": b} for a, b in sorted(own)])
                counts.append(len(stream))
                names.append([held.value.names[i] for i in sorted(of)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                    pa.array(names, pa.list_(pa.string())),
                ],
                ["doc_id", "row", "n_words", "spans", "items"],
            )

    return run


def items_digest(items: Column) -> Column:
    """Lower-case hex SHA-256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256)


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, block_chars: int = 16_000_000) -> DataFrame:
    """The documents (columns doc_id and text, all others kept) without a word inside a benchmark window."""
    scratch, kept = Scratch(documents.sparkSession, "clean"), [documents]

    def clean(held, number: int, last: bool) -> DataFrame:
        left = kept[-1].mapInArrow(_filter(held), documents.schema)
        if last:
            return left
        kept.append(scratch.save(left, f"kept-{number}"))
        scratch.drop(f"kept-{number - 1}")
        return kept[-1]

    return _one_by_one(benchmark, "item_id", "text", block_chars, window, clean)


def _filter(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            clean = [hit == 0 for _, hit, _ in held.value.scan(part.column("text").to_pylist())]
            yield part.filter(pa.array(clean, pa.bool_()))

    return run
