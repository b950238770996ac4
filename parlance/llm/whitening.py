"""Embedding whitening by hierarchical SVD merging.

Entries become integers (``floor(64 * c) + 1000000``), and the fit list holds
each integer vector once. Every partition keeps of its vectors their number,
their exact sums and the full-rank factor ``diag(s) V'`` of the centred rows.
Two of these merge by stacking both factors and one row for the difference of
their means, weighted by ``sqrt(n1 n2 / (n1 + n2))``, and decomposing the stack
again: it has exactly the scatter of all rows, and no dimension is dropped.
Partitions merge in a tree, so no task and not the driver sees more than a few
factors; a factor has as many rows and columns as vectors have entries,
whatever the number of vectors.

The vectors themselves never leave their tasks: a second pass projects them on
the components, a third over the fit list measures how far the covariance of the
result is from the identity.

Edge cases: vectors that are null, empty or hold null, NaN or infinite entries
are dropped; so are those whose length is not the commonest one (of equally
common ones the longest counts); scaled entries beyond 2**53 saturate;
``deviation`` is null where it exceeds a long; directions without variance are no
components, so a table of one distinct vector, or none, gives no rows; repeated
rows and null ids are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from parlance.llm.scratch import Scratch

_OFFSET, _SCALE, _SATURATED = 1_000_000, 64, float(1 << 53)
#: Numbers that one step of Python works on.
_CELLS = 1 << 21


@dataclass
class Factor:
    """Number, exact sums and centred factor of a set of integer vectors."""

    n: int
    sums: list[int]
    factor: np.ndarray  # rank x dimension, rows are s_i v_i


@dataclass
class Whitening:
    """Fitted components (columns) with their eigenvalues and share of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def integer_vectors(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): usable vectors of the commonest length as integers."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = lambda c: F.greatest(F.least(c.cast("double") * _SCALE, F.lit(_SATURATED)), F.lit(-_SATURATED))
    usable = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    common = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return usable.where(F.size(vector) == (common["d"] if common else 0)).select(
        F.col(vec_id).alias("vec_id"),
        F.transform(vector, lambda c: F.floor(scaled(c)) + _OFFSET).alias("x"),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded size with their vectors as a matrix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("x")
        d = len(column[0])
        step = max(1, _CELLS // d)
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def _squared(rows: np.ndarray) -> np.ndarray:
    """``diag(s) V'`` of ``rows``: the same scatter in as many rows as columns at most."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def factor_of(x: np.ndarray) -> Factor:
    """The factor of a block of integer vectors."""
    n, low = len(x), x[0]
    y = x - low
    wide = int(np.abs(y).max()) * n >= 1 << 62
    sums = [int(v) for v in (y.astype(object) if wide else y).sum(0)]
    centred = y - np.array([v / n for v in sums])
    return Factor(n, [n * int(b) + v for b, v in zip(low, sums, strict=True)], _squared(centred))


def merge(a: Factor | None, b: Factor | None) -> Factor | None:
    """The factor of both sets together; the row between them corrects for their different means."""
    if a is None or b is None:
        return a or b
    apart = np.array([(p * b.n - q * a.n) / (a.n * b.n) for p, q in zip(a.sums, b.sums, strict=True)])
    row = np.sqrt(a.n * b.n / (a.n + b.n)) * apart
    return Factor(a.n + b.n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], _squared(np.vstack([a.factor, b.factor, row])))


def _tree(states: DataFrame, merged):
    """The merged state of all rows of a one-column binary table, or None; a tree of fan-in eight."""
    rdd = states.rdd.map(lambda r: pickle.loads(r[0]))
    depth = max(2, int(np.ceil(np.log(max(2, rdd.getNumPartitions())) / np.log(8))))
    return rdd.treeAggregate(None, merged, merged, depth)


def fit(vectors: DataFrame, *, components: int = 16) -> Whitening | None:
    """The leading components of the distinct ``x`` of ``vectors``, which must hold each once; None without variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for _, x in _blocks(batches):
            state = merge(state, factor_of(x))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)])], ["state"])

    state = _tree(vectors.select("x").mapInArrow(run, "state binary"), merge)
    if state is None:
        return None
    _, s, v = np.linalg.svd(state.factor, full_matrices=False)
    s, v = s[:components], v[:components]
    real = s > (s[0] if len(s) else 0) * max(state.n, v.shape[1]) * np.finfo(float).eps
    if not real.any():
        return None
    v = v[real] * np.where(np.take_along_axis(v[real], np.abs(v[real]).argmax(1)[:, None], 1) < 0, -1, 1)
    e = s[real] ** 2 / state.n
    return Whitening(state.n, state.sums, v.T, e, s[real] ** 2 / (state.factor**2).sum())


def project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """Whitened coordinates of a block of vectors, and the exact sum of squares of ``n * x - sums``."""
    low = [s // model.n for s in model.sums]
    rest = [s - model.n * b for s, b in zip(model.sums, low, strict=True)]
    y = x - np.array(low)
    most = (int(np.abs(y).max()) + 1) * model.n
    if most**2 * x.shape[1] < 1 << 62:
        z = y * model.n - np.array(rest)
        deviation = (z * z).sum(1).tolist()
    else:
        z = y.astype(object) * model.n - np.array(rest, dtype=object)
        deviation = [v if v < 1 << 63 else None for v in (z * z).sum(1)]
    centred = y - np.array([r / model.n for r in rest])
    return centred @ model.components / np.sqrt(model.eigenvalues), deviation


@dataclass
class Moments:
    """Number, mean and centred scatter of rows."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray


def _together(a: Moments | None, b: Moments | None) -> Moments | None:
    if a is None or b is None:
        return a or b
    n, apart = a.n + b.n, b.mean - a.mean
    return Moments(n, a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance of ``vectors``, less the identity."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for _, x in _blocks(batches):
            w = project(x, held.value)[0]
            mean = w.mean(0)
            state = _together(state, Moments(len(w), mean, (w - mean).T @ (w - mean)))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)])], ["state"])

    state = _tree(vectors.select("x").mapInArrow(run, "state binary"), _together)
    return float(np.abs(state.scatter / state.n - np.eye(len(model.eigenvalues))).max())


def whiten(embeddings: DataFrame, *, components: int = 16, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component."""
    scratch = Scratch(embeddings.sparkSession, "whitening")
    vectors = integer_vectors(embeddings, vec_id=vec_id, vector=vector)
    distinct = scratch.save(vectors.select("x").distinct(), "fit")
    model = fit(distinct, components=components)
    error = identity_error(distinct, model) if model else 0.0
    held = embeddings.sparkSession.sparkContext.broadcast(model)
    kind = vectors.schema["vec_id"]
    rest = (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
    schema = StructType([StructField(kind.name, kind.dataType)])
    for name, type_name in rest:
        schema = schema.add(name, type_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch, x in _blocks(batches) if own else ():
            w, deviation = project(x, own)
            k, size = len(own.eigenvalues), w.size
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, own.n)),
                    pa.array(deviation, pa.int64()).take(each),
                    pa.array(w.ravel()),
                    pa.array(np.tile(own.explained, len(x))),
                    pa.array(np.full(size, error)),
                ],
                schema.names,
            )

    return vectors.mapInArrow(run, schema)
