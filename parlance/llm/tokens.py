"""Tokenisation and flat token streams.

Vocabularies are files named by a parameter; they are loaded once per Python
worker. A flat stream is what training jobs read: ids as little-endian unsigned
integers, each document followed by the end-of-document id, no index beside it.
The vocabulary decides both the end-of-document id (the first one it leaves
free) and the width of ids: two bytes, or four beyond 65,536 ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the container keeps public vocabularies; any other file of the same format will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The first id that this vocabulary leaves free; ``end_of_document`` finds that of any.
END_OF_DOCUMENT = 50_256

# Fixed value: the pre-tokenisation pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def end_of_document(vocabulary: str = VOCABULARY) -> int:
    """The id that closes a document: the first one that the vocabulary leaves free."""
    return encoding(vocabulary).max_token_value + 1


def id_type(vocabulary: str = VOCABULARY) -> np.dtype:
    """The narrowest unsigned little-endian type that holds all ids and the end of document."""
    return np.dtype("<u2" if end_of_document(vocabulary) < 1 << 16 else "<u4")


# White space as the pattern knows it; the pattern's engine gives up on runs near a million.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


def encode(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text; strings that look like special tokens are ordinary text.

    The pattern takes a run of white space as one piece, but for its last
    character where text follows. Very long runs are cut out just so and encoded
    as that piece, which leaves the ids as they are.
    """
    dtype = id_type(vocabulary)
    if not text:
        return np.zeros(0, dtype)
    own = encoding(vocabulary)
    if len(text) < 1 << 16:
        return np.array(own.encode_ordinary(text), dtype)
    parts, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        parts += [own.encode_ordinary(text[at : m.start()]), own._encode_single_piece(text[m.start() : end])]
        at = end
    parts.append(own.encode_ordinary(text[at:]))
    return np.concatenate([np.array(p, dtype) for p in parts])


def flat_blocks(
    documents: DataFrame,
    *,
    block_tokens: int = 1 << 20,
    vocabulary: str = VOCABULARY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(file, block, ids, doc_ids): the flat streams of the table, one per input partition, in blocks.

    ``ids`` holds ``block_tokens`` ids (the last block of a file fewer), without
    regard to documents: a document may begin in one block and end in another.
    ``doc_ids`` names the documents whose end lies in the block, in order; it is
    the manifest, not an index: it tells nothing about positions.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, held, size, ends, count = TaskContext.get().partitionId(), 0, [], 0, [], 0
        close = np.array([end_of_document(vocabulary)], id_type(vocabulary))

        def cut(ids: np.ndarray, own: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file], pa.int64()),
                    pa.array([block], pa.int64()),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays([0, len(own)], pa.array(own, ids_type)),
                ],
                ["file", "block", "ids", "doc_ids"],
            )

        ids_type = None
        for batch in batches:
            ids_type = batch.column(0).type
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encode(t, vocabulary), close))
                held.append(ids)
                size += len(ids)
                count += len(ids)
                ends.append((count, own))  # the stream's length when this document is closed
                if size < block_tokens:
                    continue
                stream, at = np.concatenate(held), 0
                while size - at >= block_tokens:
                    reach = (block + 1) * block_tokens
                    inside = [d for end, d in ends if end <= reach]
                    yield cut(stream[at : at + block_tokens], inside)
                    ends = ends[len(inside) :]
                    at, block = at + block_tokens, block + 1
                held, size = [stream[at:]], size - at
        if size:
            yield cut(np.concatenate(held), [d for _, d in ends])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run,
        f"file long, block long, ids binary, doc_ids array<{kind}>",
    )
