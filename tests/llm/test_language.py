"""Language identification against a plain version, and pages that are hard to read."""

import time
from collections import defaultdict

import numpy as np
import pytest

from parlance.llm import language

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit_trigrams(language.training_rows(spark.read.parquet(f"{SF}/documents.parquet")))


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def brute(rows, model, strength=5.0):
    """(language, probability) of each page, one page after the other."""
    host = lambda u: u.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].lower() if u and "://" in u else ""
    n = len(model.languages)
    logs = np.log(np.exp(model.logs))
    seen = []
    for _, url, html in rows:
        grams = language._trigrams(language.visible_text(html))
        ll = sum((logs[g] for g in grams.tolist()), np.zeros(n)) / np.sqrt(max(1, len(grams)))
        h = host(url)
        keys = {"host": h, "domain": ".".join(h.split(".")[-2:]), "suffix": h.split(".")[-1], "declared": language.declared_language(html)}
        seen.append((ll, softmax(ll), keys))
    sums = defaultdict(lambda: np.zeros(n))
    for _, p, keys in seen:
        for k, v in keys.items():
            sums[k, v] += p
    whole = sum((p for _, p, _ in seen), np.zeros(n))
    base = (whole + 1) / (whole.sum() + n)
    out = []
    for ll, p, keys in seen:
        rest = {k: np.maximum(sums[k, v] - p, 0) for k, v in keys.items()}
        domain = (rest["domain"] + strength * base) / (rest["domain"].sum() + strength)
        score = ll + np.log((rest["host"] + strength * domain) / (rest["host"].sum() + strength))
        for k in ("declared", "suffix") if keys["declared"] else ("suffix",):
            score = score + np.log((rest[k] + 0.1) / (whole + 1))
        post = softmax(score)
        out.append((model.languages[int(post.argmax())], float(post.max())))
    return out


def test_against_a_plain_version(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = [
        (-1, None, None),
        (-2, "http://a.de/", ""),
        (-2, "http://a.de/", ""),
        (-3, "x", '<p lang="fr">rien'),
        (None, "HTTP://B.FR?q", "<html lang=fr>"),
    ]
    rows = [tuple(r) for r in pages.collect()] + odd
    got = [(r.page_id, r.language, r.probability) for r in language.identify(pages.union(spark.createDataFrame(odd, PAGES)), model).collect()]
    want = [(r[0], *x) for r, x in zip(rows, brute(rows, model), strict=True)]
    order = lambda x: (str(x[0]), x[1], x[2])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6


HARD = [
    "<" * 5_000_000,
    "<meta " * 800_000,
    "<html " * 800_000,
    "<!--" * 1_200_000,
    "<script>" * 600_000,
    "a" * 5_000_000,
    " " * 5_000_000,
    "&#" + "9" * 4_999_000,
    "<html lang=" + " " * 5_000_000 + "1>",
    "&" * 5_000_000,
]


@pytest.mark.parametrize("page", HARD, ids=lambda p: p[:8])
def test_hard_pages_take_linear_time(model, page):
    began = time.time()
    assert language.declared_language(page) is None
    assert model.log_likelihoods(language.visible_text(page)).shape == (len(model.languages),)
    assert time.time() - began < 30


@pytest.mark.parametrize(
    "page,text,declared",
    [
        ("a < b and c", "a < b and c", None), ("<p>x</p> 1 < 2", " x  1 < 2", None), ("&#65;&#0000000066;&#99999999999;", "AB�", None),
        ('<HTML dir=ltr LANG = "De-at"><p lang="fr">', "  ", "de"), (
            '<html><meta name=x content="en"><meta http-equiv="Content-Language" content="fr">',
            "   ",
            "fr",
        ), ("<html data-lang=xx>", " ", "xx"), (None, "", None),
    ],
)
def test_reading(page, text, declared):
    assert (language.visible_text(page), language.declared_language(page)) == (text, declared)


def test_evidence_grows_with_the_text(model):
    text = "der hund und die katze mit dem haus "
    gap = [np.ptp(model.log_likelihoods(text * k)) for k in (1, 10, 100, 1000)]
    assert gap == sorted(gap) and gap[-1] > 5 * gap[1]


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_ties_name_the_first(spark, share):
    """Two languages with the same texts are equally likely everywhere."""
    same = language.fit_trigrams([("one two three", "b"), ("one two three", "a")])
    got = language.identify(spark.createDataFrame([(1, "http://h.x/", "one two" if share else "")], PAGES), same).collect()
    assert [(r.language, round(r.probability, 9)) for r in got] == [("a", 0.5)]
