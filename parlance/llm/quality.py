"""Quality classifier by compression against two trained zstandard dictionaries.

One dictionary is built from good labelled texts, one from bad ones. A text is
compressed with each; the difference of the compressed sizes, divided by the
text's own size, says which kind it resembles. A logistic curve fitted on
labelled rows that the dictionaries have not seen turns it into a probability:
it sees the plain difference and one damped for short texts, nothing else.

Edge cases: a null or empty text has difference 0 and so the curve's value at
0; a very long text is compressed piece by piece to its end; a null doc_id and
repeated rows are scored like any other row; labels that are null or not 0/1 are left out; a document with several labels
counts once for each; a label without its document is ignored; with no labelled
row of one kind the score is 0.5 for every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_PIECE = 2048  # bytes compressed at once: dictionaries help short inputs only
_SHORT = 128  # texts of about this many bytes or fewer carry little evidence


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] | None
    level: int = 3

    def features(self, text: str | None) -> tuple[float, ...]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not hasattr(self, "_with"):
            make = lambda d: zstandard.ZstdCompressor(
                self.level,
                dict_data=zstandard.ZstdCompressionDict(d),
                write_content_size=False,
                write_dict_id=False,
            )
            self._with = make(self.good), make(self.bad)
        if not raw or self.weights is None and not (self.good and self.bad):
            return (0.0, 0.0)
        sizes = [sum(len(c.compress(raw[i : i + _PIECE])) for i in range(0, len(raw), _PIECE)) for c in self._with]
        gap = sizes[1] - sizes[0]
        return (gap / (len(raw) + _SHORT), gap / len(raw))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        x = np.array([self.features(t) for t in texts], np.float64).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -500, 500)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_with"}


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ ((p - y)) + ridge * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit(rows: list[tuple[str | None, int]], *, dictionary_bytes: int = 262_144, level: int = 3) -> QualityModel:
    """Train on (text, label) rows: even rows make the dictionaries, odd rows the curve."""
    kinds = {k: [t.encode("utf-8", "surrogatepass") for t, y in rows if y == k and t] for k in (0, 1)}
    if min(map(len, kinds.values())) < 2:
        return QualityModel(b"", b"", None, level)
    # Rows alternate between the two uses within each kind.
    share = {k: (v[::2], v[1::2]) for k, v in kinds.items()}
    size = min(dictionary_bytes, *(max(1024, sum(map(len, v[0])) // 2) for v in share.values()))
    model = QualityModel(*(_dictionary(share[k][0], size) for k in (1, 0)), None, level)
    texts = [t.decode("utf-8", "surrogatepass") for k in (0, 1) for t in share[k][1]]
    y = np.array([k for k in (0, 1) for _ in share[k][1]])
    x = np.array([model.features(t) for t in texts])
    model.weights = _logistic(x, y)
    return model


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [t[i : i + _PIECE] for t in texts for i in range(0, len(t), _PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: their raw bytes serve as the dictionary
        return b"".join(pieces)[-size:]


def training_rows(documents: DataFrame, labels: DataFrame, *, rows_per_class: int = 1000, label: str = "quality") -> list[tuple[str | None, int]]:
    """A bounded sample of labelled texts: the ``rows_per_class`` smallest hashed ids of each class.

    Only the sampled ids (at most ``2 * rows_per_class``) are broadcast and only
    their whole texts reach the driver.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    ids = [chosen.where(F.col("y") == k).orderBy(rank, "doc_id").limit(rows_per_class) for k in (0, 1)]
    few = F.broadcast(ids[0].unionByName(ids[1]))
    texts = documents.select("doc_id", "text").join(few, "doc_id").select("doc_id", "text", "y").toPandas()
    texts = texts.sort_values(["doc_id", "y", "text"], na_position="first")
    return list(zip((t if isinstance(t, str) else None for t in texts["text"]), texts["y"].tolist(), strict=True))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def score_documents(documents: DataFrame, model: QualityModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``documents`` (one named ``out`` is replaced) and the score of each whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.score(batch.column(text).to_pylist()), pa.float64())],
                [*batch.schema.names, out],
            )

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(out, DoubleType())]))


def keep_good(documents: DataFrame, model: QualityModel, *, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            yield batch.filter(pa.array(own.score(batch.column("text").to_pylist()) >= threshold, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
