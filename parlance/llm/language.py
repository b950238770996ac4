"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are combined for each page: the likelihood of its visible
text under trained character trigram models, the language its markup declares,
the last label of its host, and a prior of its host. How far declarations and
host suffixes can be trusted is learned from all pages by grouped aggregation of
the text's own posteriors; host priors are smoothed towards the host's domain,
the domain's towards all pages. A page's own share is left out of its priors.

Edge cases: a null or empty page has no text evidence; a null address has the
empty host; a page without a declared language gives no declaration evidence; a
language without training text is unknown to the model; of languages that are
equally likely the first in code point order is named; repeated pages count as
often as they occur; extra columns are ignored; a very long page is read whole
and in linear time; with no training text at all every language is null.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.batches import slices
from parlance.llm.scratch import Scratch
from parlance.llm.url_filter import host_of

_BINS = 1 << 15
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAG = re.compile(r"(?s)<[^>]*+>")
# A tag's inside ends before the next bracket, so that every character is read once.
_HTML, _META = re.compile(r"(?i)<html\b([^<>]*+)"), re.compile(r"(?i)<meta\b([^<>]*+)")
_LANG = re.compile(r"""(?i)\blang\s*+=\s*+["']?+\s*+([a-z]{2,3})\b""")
_ABOUT = re.compile(r"""(?i)\bhttp-equiv\s*+=\s*+["']?+\s*+content-language\b""")
_CONTENT = re.compile(r"""(?i)\bcontent\s*+=\s*+["']?+\s*+([a-z]{2,3})\b""")
_REFERENCE = re.compile(r"&#0*+([0-9]{8,});?")  # beyond all code points


def visible_text(page: str | None) -> str:
    """The text outside of tags, scripts, styles and comments; what no ``>`` follows is no tag."""
    if not page:
        return ""
    shown = _HIDDEN.sub(" ", page)
    last = shown.rfind(">") + 1
    return entities.unescape(_REFERENCE.sub("\ufffd", _TAG.sub(" ", shown[:last]) + shown[last:]))


def declared_language(page: str | None) -> str | None:
    """The language that the first ``html`` tag with one declares, else a ``meta`` tag."""
    for tag in _HTML.finditer(page or ""):
        if found := _LANG.search(tag[1]):
            return found[1].lower()
    for tag in _META.finditer(page or ""):
        if _ABOUT.search(tag[1]) and (found := _CONTENT.search(tag[1])):
            return found[1].lower()
    return None


def _trigrams(text: str) -> np.ndarray:
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
        mixed ^= mixed >> np.uint64(15)
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(49)).astype(np.int64)


@dataclass
class TrigramModel:
    languages: list[str]
    logs: np.ndarray  # bins x languages

    def log_likelihoods(self, text: str) -> np.ndarray:
        """Log likelihood for each language, tempered to the root of the number of trigrams.

        Trigrams overlap and repeat, so n of them are far less than n independent
        observations; the root lets evidence grow with every text, but slowly.
        """
        grams = _trigrams(text)
        if not len(grams) or not self.languages:
            return np.zeros(self.logs.shape[1])
        return np.bincount(grams, minlength=_BINS) @ self.logs / np.sqrt(len(grams))


def fit_trigrams(rows: list[tuple[str | None, str]], *, smoothing: float = 0.5) -> TrigramModel:
    languages = sorted({lang for text, lang in rows if text and lang})
    counts = np.full((_BINS, max(1, len(languages))), smoothing)
    for text, lang in rows:
        if text and lang:
            counts[:, languages.index(lang)] += np.bincount(_trigrams(text), minlength=_BINS)
    return TrigramModel(languages, np.log(counts / counts.sum(0)))


def training_rows(documents: DataFrame, *, rows_per_language: int = 200) -> list[tuple[str | None, str]]:
    """A bounded sample: the ``rows_per_language`` smallest hashed ids of each language, with whole texts.

    One pass counts languages; the next keeps ids whose hash lies below each
    language's threshold (about four times the rows wanted), ranks those few, and
    broadcasts the ids chosen: at most ``rows_per_language`` of each language.
    """
    labelled = documents.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return []
    share = F.create_map(*(x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 4.0 * rows_per_language / n)))))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 52)) / float(1 << 52)
    few = labelled.withColumn("place", place).where(F.col("place") <= F.element_at(share, F.col("lang")))
    few = few.distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= rows_per_language).select("doc_id", "lang")
    picked = documents.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    return [(r.text, r.lang) for r in picked.orderBy("lang", "doc_id").collect()]


def read_pages(pages: DataFrame, model: TrigramModel, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, declared, ll): the evidence of each page; the page itself is dropped."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches, "html"):
            texts = batch.column("html").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("host"),
                    pa.array([declared_language(t) for t in texts], pa.string()),
                    pa.array([own.log_likelihoods(visible_text(t)).tolist() for t in texts], pa.list_(pa.float64())),
                ],
                ["page_id", "host", "declared", "ll"],
            )

    columns = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    return columns.mapInArrow(run, f"page_id {kind}, host string, declared string, ll array<double>")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def identify(
    pages: DataFrame,
    model: TrigramModel,
    *,
    strength: float = 5.0,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(page_id, host, declared, text_language, language, probability) of each page."""
    scratch = Scratch(pages.sparkSession, "language")
    count = len(model.languages)
    read = read_pages(pages, model, page_id=page_id, url=url, html=html)
    names = F.array(*(F.lit(x) for x in model.languages)) if count else F.array(F.lit(None).cast("string"))
    suffix = F.substring_index("host", ".", -1)
    domain = F.substring_index("host", ".", -2)
    seen = scratch.save(read.withColumn("p", _softmax(F.col("ll"))).withColumn("suffix", suffix).withColumn("domain", domain), "evidence")

    def sums(*keys: str) -> DataFrame:
        """The summed text posteriors of each group, as an array in language order."""
        total = seen.groupBy(*keys).agg(*(F.sum(F.get("p", F.lit(k))).alias(f"s{k}") for k in range(max(1, count))))
        return total.select(*keys, F.array(*(F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(max(1, count)))).alias("sums"))

    by_host = scratch.save(sums("host", "domain", "suffix"), "hosts")
    fold = lambda key: by_host.groupBy(key).agg(*(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(max(1, count)))).select(
        key,
        F.array(*(f"s{k}" for k in range(max(1, count)))).alias(f"{key}_sums"),
    )
    everything = by_host.agg(*(F.sum(F.get("sums", F.lit(k))) for k in range(max(1, count)))).first()
    whole = [float(x or 0.0) for x in everything]  # one number per language
    base = [(x + 1.0) / (sum(whole) + len(whole)) for x in whole]
    plain = F.array(*(F.lit(x) for x in base))
    smooth = lambda sums_, to: F.zip_with(
        sums_,
        to,
        lambda s, q: (F.greatest(s, F.lit(0.0)) + strength * q) / (
            F.aggregate(sums_, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0))) + strength
        ),
    )
    hosts = by_host.join(fold("domain"), "domain").join(fold("suffix"), "suffix").select("host", "sums", "domain_sums", "suffix_sums")
    claims = sums("declared").where("declared is not null").withColumnRenamed("sums", "declared_sums").withColumnRenamed("declared", "claim")

    without = lambda sums_: F.zip_with(sums_, "p", lambda s, own: s - own)  # noqa: E731  a page does not vote for itself
    # Likelihood of an observation given the language, smoothed towards no information.
    given = lambda sums_: F.zip_with(
        without(sums_),
        F.array(*(F.lit(x) for x in whole)),
        lambda s, t: F.log((F.greatest(s, F.lit(0.0)) + 0.1) / (t + 1.0)),
    )
    joined = seen.join(hosts, "host").join(claims, seen["declared"] == claims["claim"], "left")
    prior = F.transform(smooth(without(F.col("sums")), smooth(without(F.col("domain_sums")), plain)), lambda x: F.log(x))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    none = F.transform(plain, lambda x: F.lit(0.0))
    fused = add(
        add(F.col("ll"), prior),
        add(F.when(F.col("claim").isNull(), none).otherwise(given(F.col("declared_sums"))), given(F.col("suffix_sums"))),
    )
    best = lambda p: F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    out = joined.withColumn("post", _softmax(fused))
    return out.select(
        "page_id",
        "host",
        "declared",
        best(F.col("p")).alias("text_language"),
        best(F.col("post")).alias("language"),
        F.array_max("post").alias("probability"),
    )
