"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document's set holds its distinct word shingles as 64-bit hashes. Its sketch
splits the hash space into buckets and stores for the least hash of each bucket
the count of leading zeros and the mantissa bits that follow; empty buckets
borrow the register of a bucket drawn for them (optimal densification).

1. Documents with equal sets collapse into a class.
2. Bands of compressed registers name buckets of classes. Each member of a
   bucket is paired with the bucket's first member only, never with all others.
3. A pair whose collision-corrected Jaccard estimate lies clearly below the
   threshold goes (margin: six standard errors; sets of at most ``_SMALL``
   shingles are not judged by an estimate); the others are confirmed on the full
   sets, and confirmed links are joined to components.
4. Buckets that still hold several components are searched block by block: the
   sets of two blocks are intersected at once (of sets above ``_SAMPLE``
   shingles a sample, again with a margin of six standard errors), every pair
   across components is looked at, and links that join what is still apart in
   the block come out for confirmation on full sets. Buckets of more than
   ``huge`` classes are first split by the rarest shingles of their sets, in
   which two similar sets meet for certain.

So a link between documents is found unless the bands miss it (chance below 1e-6
at 0.8), and no group's pairs are ever written out. A pivot's own text or sketch is sent once for each bounded
part of its pairs, not once per pair.

Edge cases: a text without words, empty or null has an empty set and links with
nothing; a text shorter than a shingle is one shingle; a very long text is read
whole. Rows are what is linked: ``component_id`` is the least doc_id among the
rows that links reach, rows that share a doc_id are not linked by that, and all
rows whose doc_id is the component's are kept. A null doc_id has no links and no
component; ids may be of any type with an order; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import skew
from parlance.llm.batches import slices
from parlance.llm.components import connected_components
from parlance.llm.scratch import Scratch

REGISTERS = 256  # a power of two
BAND_ROWS = 5
BANDS = 36
MANTISSA = 10
_BITS = 64 - int(math.log2(REGISTERS))
_SAMPLE = 1024  # larger sets are compared inside blocks by a sample of about this size or half of it
_BLOCK = 512
_SMALL = 64  # sets up to this size go to confirmation without an estimate
_HUGE = _BLOCK * BANDS  # above this many classes, a bucket has as many blocks as there are bands

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def shingle_set(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text; A-Z count as a-z, words are split at ASCII white space."""
    if not text:
        return np.zeros(0, np.uint64)
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(acc)


_RANKS = np.argsort(np.random.Generator(np.random.PCG64(20240229)).random((REGISTERS, REGISTERS)), axis=1).astype(np.int16)
_FLOORS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_BITS)


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set: leading zeros above, mantissa bits below."""
    at = np.searchsorted(s, _FLOORS)
    least = s[np.minimum(at, len(s) - 1)]
    full = (at < len(s)) & (least >> np.uint64(_BITS) == np.arange(REGISTERS, dtype=np.uint64))
    mantissa, exponent = np.frexp((least & np.uint64((1 << _BITS) - 1)).astype(np.float64))
    fine = np.clip(((mantissa - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64), 0, (1 << MANTISSA) - 1)
    out = ((_BITS - exponent).astype(np.int64) << MANTISSA | fine).astype(np.uint16)
    if not full.all():
        empty, taken = np.flatnonzero(~full), np.flatnonzero(full)
        out[empty] = out[taken[_RANKS[np.ix_(empty, taken)].argmin(1)]]
    return out


def _level_odds(n: np.ndarray) -> np.ndarray:
    """Chance of each leading-zero count of a register of a set of n shingles."""
    level = np.arange(_BITS)
    share = np.maximum(n, 1)[:, None] / REGISTERS
    reach = lambda k: np.exp(share * np.log1p(-np.minimum(2.0**-k, 1 - 1e-12)))
    return np.maximum(reach(level + 1.0) - reach(level + 0.0), 0)


def estimate_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for registers that agree by accident."""
    same = (a == b).mean(1)
    chance = (_level_odds(n_a) * _level_odds(n_b)).sum(1) / (1 << MANTISSA)
    return np.clip((same - chance) / (1 - chance), 0, 1)


# --- stages ------------------------------------------------------------------


def sketch_documents(documents: DataFrame, *, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, n, hi, lo, sketch): a hash of the text, set size, 128-bit name of the set and its registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, hi, lo, regs = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, words)
                name = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                hi.append(int.from_bytes(name[:8], "little", signed=True))
                lo.append(int.from_bytes(name[8:], "little", signed=True))
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("print"),
                    pa.array(n, pa.int64()),
                    pa.array(hi, pa.int64()),
                    pa.array(lo, pa.int64()),
                    pa.array(regs, pa.binary()),
                ],
                ["doc_id", "print", "n", "hi", "lo", "sketch"],
            )

    kind = documents.schema[doc_id].dataType.simpleString()
    return _printed(documents, doc_id, text).mapInArrow(run, f"doc_id {kind}, print long, n long, hi long, lo long, sketch binary")


def _printed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text"))


def bands(classes: DataFrame) -> DataFrame:
    """(rep, n, band, key): each class under the hash of every band."""
    key = lambda i: F.xxhash64(F.substring("sketch", 2 * BAND_ROWS * i + 1, 2 * BAND_ROWS), F.lit(i))
    return classes.select("rep", "n", F.posexplode(F.array(*(key(i) for i in range(BANDS)))).alias("band", "key"))


def by_pivot(pairs: DataFrame, own: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, columns) sorted for one pass: behind a row with null ``b`` and what ``own`` (rep, columns) has of a pivot, its members' rows.

    A pivot with very many pairs is cut into parts, and heads each of them. Only
    such pivots, of which there are few, are broadcast.
    """
    most = max(16, skew.limit(pairs, pairs.count()))
    per = pairs.groupBy("a").agg(F.count("*").alias("n"))
    heavy = per.where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0).cast("long"))
    members = pairs.join(F.broadcast(heavy), "a", "left").select("a", "b", part.alias("part")).join(own, F.col("b") == own["rep"])
    heads = per.join(F.broadcast(heavy), "a", "left").select(
        "a",
        F.lit(None).cast("long").alias("b"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"),
    ).join(own, F.col("a") == own["rep"])
    both = members.select("a", "b", "part", *columns).unionByName(heads.select("a", "b", "part", *columns))
    return both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())


def _likely(threshold: float):
    """From rows by pivot, the (a, b) whose estimate is not clearly below the threshold."""
    margin = 6 * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regs, n = np.zeros((1, REGISTERS), np.uint16), np.zeros(1)  # the pivot's
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.vstack((regs, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)))
            n = np.append(n, batch.column("n").to_numpy())
            head = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            pivot = np.maximum.accumulate(np.where(head, np.arange(1, len(n)), 0))
            row, at = np.flatnonzero(~head) + 1, pivot[~head]
            small, large = np.minimum(n[row], n[at]), np.maximum(n[row], n[at])
            good = small >= threshold * large - 1e-6
            good[good] = (
                estimate_jaccard(regs[at[good]], regs[row[good]], n[at[good]], n[row[good]]) >= threshold - margin
            ) | (small[good] <= _SMALL)
            yield batch.select(["a", "b"]).take(pa.array(row[good] - 1))
            regs, n = regs[pivot[-1]][None], n[pivot[-1]][None]

    return run


def _confirm(threshold: float, words: int):
    """From rows by pivot, the (a, b) whose full sets reach the threshold."""
    # Integers decide: 100 * intersection >= percent * union.
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in slices(batches, "text"):
            good = []
            for b, text in zip(batch.column("b").to_pylist(), batch.column("text"), strict=True):
                other = shingle_set(text.as_py(), words)
                if b is None:
                    own = other
                both = 0 if b is None else np.intersect1d(own, other, assume_unique=True).size
                good.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _thinned_sets(texts: DataFrame, words: int) -> DataFrame:
    """(rep, level, items): the upper halves of a set's hashes; of large sets those whose first ``level`` bits are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            levels, items = [], []
            for t in batch.column("text").to_pylist():
                upper = (shingle_set(t, words) >> np.uint64(32)).astype(np.uint32)
                levels.append(min(20, max(0, (len(upper) - 1) // _SAMPLE).bit_length()))
                items.append(_thin(upper, levels[-1]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(levels, pa.int32()), pa.array(items, pa.binary())],
                ["rep", "level", "items"],
            )

    return texts.select("rep", "text").mapInArrow(run, "rep long, level int, items binary")


def _thin(items: np.ndarray, level: int) -> np.ndarray:
    return items if not level else items[items >> np.uint32(32 - level) == 0]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the left with the right sets, by products of incidence matrices."""
    values, place, seen = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    shared = seen[place] > 1
    column = np.cumsum(seen > 1) - 1
    place, rows = column[place[shared]], rows[shared]
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    out = np.zeros((len(left), len(right)), np.float32)
    count = int((seen > 1).sum())
    width = max(1, min(count, (1 << 22) // (len(left) + len(right))))
    for lo in range(0, count, width):
        a, b = np.searchsorted(place, (lo, lo + width))
        grid = np.zeros((len(left) + len(right), width), np.float32)
        grid[rows[a:b], place[a:b] - lo] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def _block_links(
    threshold: float,
    n: np.ndarray,
    root: np.ndarray,
    level: np.ndarray,
    items: list[np.ndarray],
    side: np.ndarray,
) -> list[tuple[int, int]]:
    """Places of pairs to confirm: likely links between components that no surer link in the block has joined."""
    percent = round(100 * threshold)
    leader = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while leader[r] != r:
            leader[r] = r = leader[leader[r]]
        return r

    found: list[tuple[float, bool, int, int]] = []
    for top in np.unique(level).tolist():
        fit = np.flatnonzero((level == top) | (level == top - 1))
        left, right = fit[side[fit] != 1], fit[side[fit] != 0]
        if not len(left) or not len(right):
            continue
        ok = (root[left][:, None] != root[right]) & (np.maximum(level[left][:, None], level[right]) == top)
        ok &= 100 * np.minimum(n[left][:, None], n[right]) >= percent * np.maximum(n[left][:, None], n[right])
        if side[0] == 2:
            ok &= left[:, None] < right
        if not ok.any():
            continue
        at = {k: _thin(items[k], top) for k in fit.tolist()}
        both = _common([at[k] for k in left.tolist()], [at[k] for k in right.tolist()])
        sizes = n if not top else np.array([len(at.get(k, ())) for k in range(len(n))])
        union = np.maximum(sizes[left][:, None] + sizes[right] - both, 1)
        jaccard = both / union
        margin = 6 * np.sqrt(threshold * (1 - threshold) / union) if top else 3 / union
        i, j = np.nonzero(ok & (jaccard >= threshold - (margin if top else 0)))
        sure = jaccard >= threshold + margin
        found += [(float(jaccard[a, b]), bool(sure[a, b]), int(left[a]), int(right[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    out = []
    for _, sure, a, b in sorted(found, key=lambda f: (-f[1], -f[0], f[2], f[3])):
        ra, rb = find(int(root[a])), find(int(root[b]))
        if ra != rb:
            out.append((a, b))
            if sure:
                leader[max(ra, rb)] = min(ra, rb)
    return out


def _across(threshold: float):
    """Pairs (a, b) to confirm from rows of two blocks of a bucket, which come sorted by (key, i, j)."""

    def close(rows: pa.RecordBatch) -> pa.RecordBatch:
        place = np.column_stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
        edges = np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1
        n, root, rep, side, level = (rows.column(c).to_numpy() for c in ("n", "root", "rep", "side", "level"))
        items = [np.frombuffer(x, np.uint32) for x in rows.column("items").to_pylist()]
        out = []
        for lo, hi in zip([0, *edges], [*edges, rows.num_rows], strict=True):
            if hi - lo > 1:
                out += [
                    (rep[lo + a], rep[lo + b]) for a, b in _block_links(threshold, n[lo:hi], root[lo:hi], level[lo:hi], items[lo:hi], side[lo:hi])
                ]
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:  # the last group of a batch may go on in the next
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()[0]
            place = np.column_stack([whole.column(c).to_numpy() for c in ("key", "i", "j")])
            first = int(np.argmax((place == place[-1]).all(1)))
            if first:
                yield close(whole.slice(0, first))
            waiting = [whole.slice(first)]
        if waiting:
            yield close(waiting[0])

    return run


def near_duplicates(
    documents: DataFrame,
    *,
    threshold: float = 0.8,
    words: int = 5,
    huge: int = _HUGE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    scratch = Scratch(documents.sparkSession, "near")
    sketches = scratch.save(sketch_documents(documents, words=words, doc_id=doc_id, text=text), "sketches")
    # One row, by id and text, stands for a class; the class itself gets a number of its own.
    grouped = sketches.where("n > 0 and doc_id is not null").groupBy("n", "hi", "lo").agg(
        F.min(F.struct("doc_id", "print")).alias("pick"),
        F.count("*").alias("copies"),
        F.first("sketch").alias("sketch"),
    )
    classes = scratch.save(grouped.select(F.monotonically_increasing_id().alias("rep"), "n", "hi", "lo", "copies", "pick", "sketch"), "classes")
    banded = bands(classes)
    shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    heavy = shared.where(F.col("m") > skew.limit(classes, BANDS * classes.count()))
    members = skew.lookup(banded.withColumn("bucket", F.col("key")), shared, heavy, ["key"], ["pivot", "m"], F.xxhash64("rep", "band"))
    members = scratch.save(members.where("m is not null").withColumnRenamed("bucket", "key"), "members")
    needed = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "pick.doc_id", "pick.print")
    texts = _printed(documents, doc_id, text).join(needed, ["doc_id", "print"]).select("rep", "text")
    if sketches.groupBy("doc_id", "print").count().where("count > 1 and doc_id is not null").limit(1).count():
        texts = texts.groupBy("rep").agg(F.first("text").alias("text"))  # the same row several times
    texts = scratch.save(texts, "texts")

    def links(pairs: DataFrame, table: str) -> DataFrame:
        pairs = scratch.save(pairs, f"{table}-pairs")
        likely = scratch.save(by_pivot(pairs, classes, ["n", "sketch"]).mapInArrow(_likely(threshold), "a long, b long"), f"{table}-likely")
        return scratch.save(by_pivot(likely, texts, ["text"]).mapInArrow(_confirm(threshold, words), "a long, b long").distinct(), table)

    pairs = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    edges = links(pairs, "links-0")
    roots = connected_components(edges, scratch, "roots-0")
    edges = edges.unionByName(links(_open_pairs(members, texts, roots, scratch, threshold, words, huge), "links-1"))
    roots = connected_components(edges, scratch, "roots-1")
    # The result reads only the sketches, the classes and the roots.
    scratch.drop("members", "texts", "open", "open-split", "thinned", *(f"links-{k}{part}" for k in (0, 1) for part in ("", "-likely", "-pairs")))

    rooted = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep",
        "n",
        "hi",
        "lo",
        "copies",
        "pick.doc_id",
        F.coalesce("root", "rep").alias("root"),
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    some = least.where(F.col("m") > skew.limit(classes, classes.count()))
    named = scratch.save(skew.lookup(rooted, least, some, ["root"], ["component_id"], F.xxhash64("rep")), "named")
    copied = named.where(F.col("copies") > skew.limit(sketches, sketches.count()))
    row = F.xxhash64("doc_id", "print", F.monotonically_increasing_id())
    out = skew.lookup(sketches.withColumn("size", F.col("n")).drop("sketch"), named, copied, ["hi", "lo", "n"], ["component_id"], row)
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        root.alias("component_id"),
        F.coalesce(F.col("doc_id") == root, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, *, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """One document of every group of near duplicates, with all its columns.

    Rows are numbered first, so that repeated rows and rows without a doc_id
    count one by one; of a group the first row stays.
    """
    numbered = Scratch(documents.sparkSession, "rows").save(documents.withColumn("__near_row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select("__near_row", "text"), threshold=threshold, words=words, doc_id="__near_row")
    return numbered.join(found.where("kept").select(F.col("doc_id").alias("__near_row")), "__near_row", "left_semi").select(*documents.columns)


def _open_pairs(
    members: DataFrame,
    texts: DataFrame,
    roots: DataFrame,
    scratch: Scratch,
    threshold: float,
    words: int,
    huge: int,
) -> DataFrame:
    """Pairs to confirm across components in the buckets that hold more than one."""
    rooted = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key",
        "rep",
        "n",
        "m",
        F.coalesce("root", "rep").alias("root"),
    )
    open_ = scratch.save(_several(rooted), "open")
    needed = scratch.save(_thinned_sets(texts.join(open_.select("rep").distinct(), "rep", "left_semi"), words), "thinned")
    blocks = F.ceil(F.col("m") / _BLOCK).cast("int")
    own, other = F.pmod(F.xxhash64("rep"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = open_.where(F.col("m") <= huge).withColumn("own", own).withColumn("other", other)
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    spread = dealt.select("key", "rep", "n", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    if (open_.agg(F.max("m")).first()[0] or 0) > huge:
        split = scratch.save(_by_rare_shingles(open_.where(F.col("m") > huge), texts, words, threshold), "open-split")
        for kind, role, mine, theirs, number in ((F.col("first"), "i", "first_m", "m", 0), (F.lit(True), "j", "m", "first_m", 1)):
            count = lambda c: F.ceil(F.col(c) / _BLOCK).cast("int")
            place = F.pmod(F.xxhash64("rep"), count(mine)).cast("int").alias(role)
            beside = F.explode(F.sequence(F.lit(0), count(theirs) - 1)).alias("j" if role == "i" else "i")
            spread = spread.unionByName(split.where(kind).select("key", "rep", "n", "root", place, beside, F.lit(number).alias("side")))
    rows = spread.join(needed, "rep").select("rep", "n", "root", "level", "items", "key", "i", "j", "side")
    grouped = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(_across(threshold), "a long, b long").distinct()


def _by_rare_shingles(large: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(key, rep, n, root, first, m, first_m): huge buckets split by shingles, without losing a pair.

    A set's shingles are put in order, those that fewest sets of the bucket have
    first. Two sets at the threshold share one of the first ``n - ceil(t n) + 1``
    of the larger and of the first ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller
    one (``first``): what many sets have in common stands behind both. So a part
    holds the sets that a rare shingle leads to, and only its ``first`` sets have
    to meet the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32))
            items = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), items], ["rep", "items"])

    sets = texts.join(large.select("rep").distinct(), "rep", "left_semi").select("rep", "text").mapInArrow(run, "rep long, items array<long>")
    each = large.select("key", "rep", "n", "root").join(sets, "rep").select("key", "rep", "n", "root", F.explode("items").alias("item"))
    often = each.groupBy("key", "item").agg(F.count("*").alias("often"))
    total = int(large.agg(F.sum("n")).first()[0] or 0)
    heavy = often.where(F.col("often") > skew.limit(large, total))
    kept = each.withColumn("bucket", F.col("key")).withColumn("shingle", F.col("item"))
    known = skew.lookup(kept, often, heavy, ["key", "item"], ["often"], F.xxhash64("rep", "shingle"))
    place = F.row_number().over(Window.partitionBy("bucket", "rep").orderBy("often", "shingle"))
    percent = round(100 * threshold)
    led = known.withColumn("place", place).where(f"place <= n - (({percent} * n + 99) div 100) + 1").select(
        F.xxhash64("bucket", "shingle").alias("key"),
        "rep",
        "n",
        "root",
        F.expr(f"place <= n - ((2 * {percent} * n + {99 + percent}) div {100 + percent}) + 1").alias("first"),
    )
    sizes = led.groupBy("key").agg(F.count("*").alias("m"), F.count_if("first").alias("first_m"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    return led.join(sizes.where("first_m > 0 and r0 <> r1").select("key", "m", "first_m"), "key")


def _several(rows: DataFrame) -> DataFrame:
    """The rows of buckets (``key``) that hold more than one component."""
    still = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    return rows.join(still, "key", "left_semi")
