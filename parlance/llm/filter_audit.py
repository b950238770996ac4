"""Filter interaction audit: what each filter removes in every order of filters.

Every text gets a mask of the filters that it fails. Four are judged on the text
alone; the fifth fails rows whose text a smaller id has, anywhere in the table.
For that, texts are routed by an RDD that is partitioned by their xxhash. A
partition keeps for each fingerprint a chain of the different texts that share
it, compared in full, each with the least id seen so far; whatever is not least,
or is no longer, leaves at once as a non-minimum row. Tasks do the same on
their own input first, so of a text with any number of copies a task sends one.

``combineByKey`` then merges the masks of each part into vectors of counts: 32
masks, for all rows, for good and for toxic ones. All orders are read off these
vectors; no document is looked at again.

Bounds: a task's own chains are sent on once they hold ``HELD_BYTES``; the bytes
of all texts are summed up first, and there are as many routed partitions as
keeps the texts of each at ``ROUTED_BYTES`` on average.

Edge cases: a null text is empty, and all empty texts are equal; a null source
is the part with the empty name; a null id is not smaller than any other, nor any
smaller than it, so such rows never fail as copies; rows of one text that share
the least id are all minimal; rows that share an id are rows of their own; a
document is good or toxic if any of its label rows says so, others have none;
parts without rows do not occur, an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")
HELD_BYTES = 16 << 20
ROUTED_BYTES = 64 << 20

_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))

Judged = tuple[object, str, int, int]  # id, part, mask, rows


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails; words lie between ASCII white space."""
    words = text.split()
    points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _FOLLOWING))
    fails = (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * points[0] > 5 * points[1],
        len(text.translate(None, _MARKS)) < len(text),
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


class Chains:
    """Texts by fingerprint, each with its mask, its least id and the parts of the rows that have it."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, at: int, text: bytes, mask: Callable[[], int], doc_id: object, parts: dict[str, int]) -> Iterator[Judged]:
        """Take rows of one text and id; give back those that are now known not to be minimal."""
        chain = self.by_print.setdefault(at, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            chain.append([text, mask(), doc_id, dict(parts)])
            self.bytes += len(text) + 200
            return
        if doc_id == entry[2]:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return
        late, rows = (doc_id, parts) if doc_id > entry[2] else (entry[2], entry[3])
        if doc_id < entry[2]:
            entry[2:] = [doc_id, dict(parts)]
        for part, n in rows.items():
            yield late, part, entry[1] | _COPY, n

    def drain(self) -> Iterator[tuple[int, list]]:
        for at, chain in self.by_print.items():
            for entry in chain:
                yield at, entry
        self.by_print, self.bytes = {}, 0


def _send(fingerprint: Callable[[bytes], int]):
    """Rows (id, part, text) to (fingerprint, chain entry) and (any number, judged row)."""

    def run(rows: Iterator) -> Iterator[tuple[int, object]]:
        own, turn = Chains(), 0
        for doc_id, part, text in rows:
            data = text.encode("utf-8", "surrogatepass")
            at = fingerprint(data)
            done = [(None, part, text_mask(data), 1)] if doc_id is None else own.add(at, data, lambda: text_mask(data), doc_id, {part: 1})  # noqa: B023
            for row in done:  # judged already: spread, as their text may have many copies
                turn += 1
                yield at + turn, row
            if own.bytes > HELD_BYTES:
                yield from own.drain()
        yield from own.drain()

    return run


def _judge(rows: Iterator) -> Iterator[Judged]:
    own = Chains()
    for at, row in rows:
        if isinstance(row, tuple):
            yield row
        else:
            text, mask, doc_id, parts = row
            yield from own.add(at, text, lambda: mask, doc_id, parts)  # noqa: B023
    for _, (_, mask, doc_id, parts) in own.drain():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def document_masks(
    documents: DataFrame,
    *,
    fingerprint: Callable[[bytes], int] = xxhash.xxh3_64_intdigest,
    partitions: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """(doc_id, part, mask, n): the filters that rows fail, bit k for filter k; n rows each."""
    spark = documents.sparkSession
    empty = F.lit("")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(part, empty).alias("part"), F.coalesce(text, empty).alias("text"))
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // ROUTED_BYTES)
    routed: RDD = rows.rdd.mapPartitions(_send(fingerprint)).partitionBy(partitions, lambda at: at)
    schema = StructType([rows.schema["doc_id"], StructField("part", StringType()), StructField("mask", IntegerType()), StructField("n", LongType())])
    return spark.createDataFrame(routed.mapPartitions(_judge), schema, verifySchema=False)


def _vector(row) -> np.ndarray:
    """Counts of one row's mask: all, good, toxic."""
    out = np.zeros((3, 1 << len(FILTERS)), np.int64)
    out[:, row.mask] = row.n, row.n * row.good, row.n * row.toxic
    return out


def _add(counts: np.ndarray, row) -> np.ndarray:
    counts[:, row.mask] += row.n, row.n * row.good, row.n * row.toxic
    return counts


def orders(counts: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order and step."""
    masks = np.arange(1 << len(FILTERS))
    rows, total = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, seen = (masks & bit) > 0, (masks & before) == 0
            removed, good, toxic = (int(c[fails & seen].sum()) for c in counts)
            before |= bit
            kept, redundant = int(counts[0][(masks & before) == 0].sum()), int(counts[0][fails & ~seen].sum())
            total[name] += removed
            rows.append(("".join(order), step, kept, removed, redundant, int(counts[0][bit]), good, toxic))
    for row in rows:
        yield *row, total[row[0][row[1] - 1]]


def audit_filters(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per part, order of the filters and step; ``options`` are those of ``document_masks``."""
    says = lambda column: F.max(F.coalesce(F.col(column) == 1, F.lit(False)).cast("int"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    # Rows that share an id are summed first, so a common id, or none, is no hot key of the join.
    masks = document_masks(documents, doc_id=doc_id, **options).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    marked = masks.join(marks, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counts = marked.rdd.map(lambda r: (r.part, r)).combineByKey(_vector, _add, lambda a, b: a + b)
    rows = counts.flatMap(lambda pair: ((pair[0], *row) for row in orders(pair[1])))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return documents.sparkSession.createDataFrame(rows, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names), verifySchema=False)
