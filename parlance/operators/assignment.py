"""Optimal assignment and the error rates that rest on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import alignment, intervals as iv


def cheapest(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest perfect matching of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    rows, cols = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)  # row that holds each column, 1-based; 0 is free
    for row in range(1, n + 1):
        owner[0] = row
        reach, used, trail = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        at = 0
        while owner[at]:
            used[at] = True
            slack = cost[owner[at] - 1] - rows[owner[at]] - cols[1:]
            closer = ~used[1:] & (slack < reach[1:])
            reach[1:][closer], trail[1:][closer] = slack[closer], at
            open_ = np.flatnonzero(~used)
            nxt = open_[np.argmin(reach[open_])]
            step = reach[nxt]
            rows[owner[used]] += step
            cols[used] -= step
            reach[~used] -= step
            at = nxt
        while at:
            owner[at] = owner[trail[at]]
            at = trail[at]
    out = [0] * n
    for column in range(1, n + 1):
        out[owner[column] - 1] = column - 1
    return out


def assign_costs(costs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, hyp, cost) of the cheapest assignment per key from rows (keys, ref, hyp, cost).

    A pair without a row costs nothing; null stands for a missing side. Of equally
    cheap assignments of up to six a side the first is taken, in order of the
    hyp of the first ref, then of the second and so on; beyond six, one of them.
    """
    schema = costs.select(*keys, "ref", "hyp", F.col("cost").cast("long").alias("cost")).schema

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        refs, hyps = sorted(frame["ref"].dropna().unique()), sorted(frame["hyp"].dropna().unique())
        n = max(len(refs), len(hyps))
        table = {
            (
                r if isinstance(r, str) else None,
                h if isinstance(h, str) else None,
            ): c for r, h, c in frame[["ref", "hyp", "cost"]].itertuples(index=False)
        }
        of = lambda names, i: names[i] if i < len(names) else None
        matrix = np.array([[table.get((of(refs, i), of(hyps, j)), 0) for j in range(n)] for i in range(n)], float).reshape(n, n)
        spread = n**n if n <= 6 else 1
        order = np.array([[j * n ** (n - 1 - i) if n <= 6 else 0 for j in range(n)] for i in range(n)], float).reshape(n, n)
        rows = [(*(frame[k].iloc[0] for k in keys), of(refs, i), of(hyps, j), int(matrix[i, j])) for i, j in enumerate(cheapest(matrix * spread + order))]
        return pd.DataFrame(rows, columns=schema.names)

    return costs.groupBy(*keys).applyInPandas(solve, schema)


def cp_errors(ref: DataFrame, hyp: DataFrame, keys: list[str], unit: str = "word") -> DataFrame:
    """(keys, errors, mapped, n_ref): edits under the cheapest assignment of hypothesis to reference speakers.

    Both sides have (keys, speaker, words). A side with fewer speakers is filled
    up with silence. ``unit`` word counts words, char the characters of the words.
    Speakers of a recording are paired, not lines, and of any length.
    """
    none = F.lit(None).cast("string")
    filled = lambda df, s, w: df.select(*keys, F.col("speaker").cast("string").alias(s), F.col("words").alias(w)).unionByName(
        ref.select(*keys).union(hyp.select(*keys)).distinct().select(*keys, none.alias(s), F.array().cast("array<string>").alias(w))
    )
    text = lambda c: F.array_join(c, "")
    cost = alignment.edits(F.col("rw"), F.col("hw"), unit)
    pairs = filled(ref, "ref", "rw").join(filled(hyp, "hyp", "hw"), keys).where("ref is not null or hyp is not null")
    size = F.size("words") if unit == "word" else F.length(text("words"))
    counted = ref.groupBy(*keys).agg(F.sum(size).alias("n_ref"))
    best = assign_costs(pairs.select(*keys, "ref", "hyp", cost.alias("cost")), keys)
    per = best.groupBy(*keys).agg(F.sum("cost").alias("errors"), F.count_if(F.col("ref").isNotNull() & F.col("hyp").isNotNull()).alias("mapped"))
    return per.join(counted, keys, "left").withColumn("n_ref", F.coalesce("n_ref", F.lit(0).cast("long")))


def _outside_collar(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides as (keys, label, start, end), labels as text, without the time around the reference's boundaries."""
    named = lambda df: df.select(*keys, F.col("label").cast("string").alias("label"), "start", "end")
    reference, hypothesis = named(reference), named(hypothesis)
    if not collar:
        return reference, hypothesis
    half = collar // 2
    edges = reference.select(*keys, F.explode(F.array("start", "end")).alias("t"))
    near = iv.regions_of(edges.select(*keys, (F.col("t") - half).alias("start"), (F.col("t") + half).alias("end")), keys)
    cut = lambda df: iv.subtract(df.withColumnRenamed("label", "speaker"), near, keys, cell).select(*keys, F.col("speaker").alias("label"), "start", "end")
    return cut(reference), cut(hypothesis)


def speaker_mapping(reference: DataFrame, hypothesis: DataFrame, keys: list[str], cell: int = 3_600_000) -> DataFrame:
    """(keys, ref, hyp, shared): the one-to-one mapping of labels with most shared time; pairs that share none are left out.

    Only pairs of labels that meet are rows, any number of labels a side.
    """
    met = iv.intersecting(reference.select(*keys, "label", "start", "end"), hypothesis.select(*keys, "label", "start", "end"), keys, cell)
    shared = met.groupBy(*keys, F.col("label_a").alias("ref"), F.col("label_b").alias("hyp")).agg(
        (-F.sum(F.least("end_a", "end_b") - F.greatest("start_a", "start_b"))).alias("cost")
    )
    return assign_costs(shared, keys).where("cost < 0").select(*keys, "ref", "hyp", (-F.col("cost")).alias("shared"))


def der_parts(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar: int = 0, cell: int = 3_600_000) -> DataFrame:
    """(keys, total, missed, false_alarm, paired, matched): diarization error parts by elementary slices.

    Both sides have (keys, label, start, end) with disjoint intervals per label
    and any number of labels; ``matched`` is the time of the best mapping, and
    ``paired - matched`` is confused. With a collar, time within half of it
    around every reference boundary is left out.
    """
    reference, hypothesis = _outside_collar(reference, hypothesis, keys, collar, cell)
    both = reference.select(*keys, "start", "end", F.lit(1).alias("r"), F.lit(0).alias("h")).unionByName(
        hypothesis.select(*keys, "start", "end", F.lit(0).alias("r"), F.lit(1).alias("h"))
    )
    size = F.col("end") - F.col("start")
    parts = iv.slices(both, keys, ["r", "h"]).groupBy(*keys).agg(
        F.sum(size * F.col("r")).alias("total"), F.sum(size * F.greatest(F.lit(0), F.col("r") - F.col("h"))).alias("missed"),
        F.sum(size * F.greatest(F.lit(0), F.col("h") - F.col("r"))).alias("false_alarm"), F.sum(size * F.least("r", "h")).alias("paired"),
    )
    matched = speaker_mapping(reference, hypothesis, keys, cell).groupBy(*keys).agg(F.sum("shared").alias("matched"))
    return parts.join(matched, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long")))


def jaccard_parts(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar: int = 0, cell: int = 3_600_000) -> DataFrame:
    """(keys, label, own, other, shared) of every reference label: its time, that of its mapped label, and what they share."""
    reference, hypothesis = _outside_collar(reference, hypothesis, keys, collar, cell)
    time = F.sum(F.col("end") - F.col("start"))
    own = reference.where("end > start").groupBy(*keys, "label").agg(time.alias("own"))
    other = hypothesis.where("end > start").groupBy(*keys, F.col("label").alias("hyp")).agg(time.alias("other"))
    mapping = speaker_mapping(reference, hypothesis, keys, cell).withColumnRenamed("ref", "label")
    joined = own.join(mapping, [*keys, "label"], "left").join(other, [*keys, "hyp"], "left")
    return joined.select(*keys, "label", "own", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("other", "shared")))
