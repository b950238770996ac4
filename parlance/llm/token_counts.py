"""Token counts by a separator scan over flat, unindexed token streams.

Blocks of a stream are searched for the end-of-document id independently (one
vectorised comparison each). What a block cannot know is where the document
began that ends first in it; a prefix scan over the blocks' last separators, per
file, stitches that. Only the blocks' summaries are windowed, never the tokens.

Edge cases: an empty or null text is a document of 0 tokens; tokens after the
last separator belong to no document; a document longer than a block, or many
blocks, is stitched as any other; a file without separators has no documents;
rows that share a doc_id, and rows without one, are documents of their own;
columns but file, block, ids and doc_ids are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.tokens import END_OF_DOCUMENT


def scan_blocks(blocks: DataFrame, *, end: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """(file, block, n, ends, doc_ids): positions of separators inside each block; the tokens are dropped."""
    named = "doc_ids" in blocks.columns
    kind = blocks.schema["doc_ids"].dataType.simpleString() if named else "array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), dtype)
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == end))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file"),
                    batch.column("block"),
                    pa.array(sizes, pa.int64()),
                    ends,
                    batch.column("doc_ids") if named else pa.nulls(batch.num_rows, pa.list_(pa.int64())),
                ],
                ["file", "block", "n", "ends", "doc_ids"],
            )

    kind_of = lambda c: blocks.schema[c].dataType.simpleString()
    return blocks.mapInArrow(run, f"file {kind_of('file')}, block {kind_of('block')}, n long, ends array<long>, doc_ids {kind}")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id, start, n_tokens): documents of every file, joined across block borders."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))
    placed = scanned.withColumn("base", base).withColumn("count", F.size("ends").cast("long"))
    last = F.when(F.col("count") > 0, F.col("base") + F.element_at("ends", -1))
    placed = placed.withColumn("last", last)
    placed = placed.withColumn("from", F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("long"))).withColumn(
        "first",
        F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")),
    )
    each = placed.where("count > 0").select("file", "base", "from", "first", "ends", "doc_ids", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("from")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1) + 1)
    return each.select(
        "file",
        (F.col("first") + F.col("k")).alias("ordinal"),
        F.get("doc_ids", "k").alias("doc_id"),
        start.alias("start"),
        (F.col("base") + F.col("end") - start).alias("n_tokens"),
    )


def count_tokens(blocks: DataFrame, *, end: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """Tokens of every document in flat blocks (file, block, ids, and doc_ids where known)."""
    return stitch(scan_blocks(blocks, end=end, dtype=dtype))


def read_token_files(spark: SparkSession, path: str, *, block_tokens: int = 1 << 20, dtype: str = "<u2") -> DataFrame:
    """(file, block, ids) of token files of any size under ``path``.

    Spark lists the files without reading them; every block is a row of (file,
    offset, length), and the task that has it reads that range and no more. The
    store must be one that Arrow's file systems open. A document cannot go on
    from one file to the next; bytes that are no whole token at a file's end are
    left out.
    """
    width = np.dtype(dtype).itemsize
    step = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.expr(f"length div {width} * {width}").alias("length"))
    ranges = files.where("length > 0").select("file", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))
    ranges = ranges.select("file", "block", (F.col("block") * step).alias("offset"), F.expr(f"least({step}L, length - block * {step})").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = re.sub(r"^file:/+", "file:///", row["file"])
                store, at = fs.FileSystem.from_uri(quote(name, safe="/:@"))
                with store.open_input_file(at) as source:
                    ids = source.read_at(row["size"], row["offset"])
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([ids], pa.binary())], ["file", "block", "ids"])

    return ranges.repartition("file", "block").mapInArrow(run, "file string, block long, ids binary")
