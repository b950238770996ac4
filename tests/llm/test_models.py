import zlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import language, quality, url_filter


def test_learnable_is_crc_of_the_text(spark):
    got = {r.doc_id: r.l for r in spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", quality.learnable().alias("l")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200)}


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.training_rows(documents, labels.where(quality.learnable())))
    held = documents.join(labels.where(~quality.learnable()), "doc_id")
    rows = quality.score_documents(held, model).select("quality", "score").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows)
    assert right > 0.97
    assert sum(r.score >= 0.5 for r in rows if r.quality == 1) / sum(r.quality == 1 for r in rows) > 0.97


def test_quality_edges(spark, table):
    rows = [(i, t) for i, t in enumerate(["fine words here. " * 9] * 6 + ["BUY!! NOW!! $$$ " * 9] * 6 + [None, ""])]
    labels = spark.createDataFrame(
        [(i, 1 if i < 6 else 0) for i in range(12)] + [(12, 1), (500, 0), (3, None), (None, 1), (4, 7)],
        "doc_id long, quality int",
    )
    model = quality.fit(quality.training_rows(table(rows), labels))
    got = {r.doc_id: r.score for r in quality.score_documents(table(rows), model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[0] > 0.5 > got[6] and got[12] == got[13]
    assert quality.keep_good(table(rows), model).columns == table(rows).columns
    assert quality.score_documents(table([]), model).collect() == []
    plain = quality.fit([])
    assert plain.score(["a", None]).tolist() == [0.5, 0.5]


PAGES = "page_id long, url string, html string, host string, path string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", "v") for r in rows], PAGES)


@pytest.mark.parametrize(
    "url,host,path",
    [
        ("http://A.com/en/x?y", "a.com", "/en/x"),
        ("https://b.c#f", "b.c", ""),
        ("ftp://É.Com", "É.com", ""),
        ("nothing", "", ""),
        (None, "", ""),
        ("x://a://b/c", "a:", "//b/c"),
        ("://", "", ""),
    ],
)
def test_host_and_path(spark, url, host, path):
    r = pages(spark, [(1, url, None)]).select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p")).first()
    assert (r.h, r.p) == (host, path)


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "bad.org", ""), ("allow", "good.org", "/")]


def test_rules_and_propagation(spark):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [
        (1, "http://www.example.com/en/75", None), (2, "http://x.com/en/1", None), (3, "http://xcom/en/1", None), (4, None, "<p>"), (4, None, "<p>"),
        (5, "http://bad.org/", link("http://friend.net/")), (6, "http://farm.net/q", link("//bad.org/x", "/local")), (7, "http://good.org/", link("https://nice.net/a")), (8, "http://nice.net/z", ""), (9, "http://alone.net/", None),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages(spark, rows), RULES, hierarchy=False).collect()}
    assert got == {
        1: ("example.com/en/7", "allow"),
        2: ("com/en/", "block"),
        3: (None, "allow"),
        4: (None, "allow"),
        5: ("bad.org", "block"),
        6: (None, "block"),
        7: ("good.org/", "allow"),
        8: (None, "allow"),
        9: (None, "allow"),
    }
    assert url_filter.judge(pages(spark, []), RULES).collect() == []


def test_propagation_against_plain_loops(spark):
    from parlance.llm.scratch import Scratch

    edges = {("a", "b"): 1.0, ("a", "c"): 3.0, ("b", "c"): 1.0, ("c", "a"): 1.0, ("d", "c"): 2.0}
    df = spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 2.0), ("d", 2.0)], "host string, seed double")
    got = {r.host: r.score for r in url_filter.propagate(df, seeds, Scratch(spark, "t"), "x", rounds=5).collect()}
    score = {"a": 0.5, "d": 0.5}
    for _ in range(5):
        new = {"a": 0.075, "d": 0.075}
        for (s, t), w in edges.items():
            new[t] = new.get(t, 0) + 0.85 * score.get(s, 0) * w / sum(x for (p, _), x in edges.items() if p == s)
        score = new
    assert got.keys() == score.keys() and all(abs(got[h] - score[h]) < 1e-12 for h in score)


def test_language(spark):
    rows = [("the cat and the dog with this house", "en"), ("der hund und die katze mit dem haus", "de")] * 3 + [(None, "en"), ("x", None)]
    model = language.fit_trigrams(rows)
    table = [
        (1, "http://h.de/", '<html lang="de"><p>der hund und die katze</p>'),
        (2, "http://h.de/", "<script>the the the</script>die katze mit dem haus"),
        (3, "http://i.com/", "<p>the dog and the cat</p>"),
        (4, None, None),
        (4, None, None),
        (5, "http://h.de/", ""),
    ]
    got = {r.page_id: r for r in language.identify(pages(spark, table), model).collect()}
    assert (got[1].language, got[1].declared, got[2].language, got[3].language) == ("de", "de", "de", "en")
    assert got[5].language == "de"  # nothing but its host
    assert got[4].language in ("en", "de") and 0 < got[4].probability <= 1
    assert language.identify(pages(spark, []), model).collect() == []
    assert {r.language for r in language.identify(pages(spark, table), language.fit_trigrams([])).collect()} == {None}


def test_language_on_pages_of_known_language(spark):
    d = "/root/testdata/sf0.001"
    model = language.fit_trigrams(language.training_rows(spark.read.parquet(f"{d}/documents.parquet")))
    rows = language.identify(spark.read.parquet(f"{d}/pages.parquet"), model).collect()
    assert sum(r.language == r.declared for r in rows) / len(rows) > 0.95
