"""Propagation reaches every host that links can reach, and stops within its tolerance."""

import numpy as np
import pytest

from parlance.llm import url_filter
from parlance.llm.scratch import Scratch

PAGES = "page_id long, url string, html string"
RULES = [("block", "bad.com", "/"), ("allow", "good.com", "/")]


@pytest.fixture
def brisk(spark):
    """Small tables need no partitions and no plans at run time."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("links", [9, 200])
def test_distrust_reaches_the_far_end_of_a_chain(spark, brisk, links):
    names = [f"h{k}.com" for k in range(links)] + ["bad.com"]
    rows = [(k, f"http://{n}/", f'<a href="http://{names[k + 1]}/">' if k < links else "") for k, n in enumerate(names)]
    got = url_filter.judge(spark.createDataFrame(rows, PAGES), RULES).collect()
    assert {r.verdict for r in got} == {"block"} and min(r.distrust for r in got) > 0


def test_scores_are_the_stationary_ones(spark, brisk):
    """Ties of hosts to parents alternate by round: the case where few rounds are furthest off."""
    edges = [
        ("a", "a", 2.0),
        ("a", "p", 1.0),
        ("p", "a", 1.0),
        ("b", "p", 2.0),
        ("p", "b", 1.0),
        ("b", "c", 1.0),
        ("c", "d", 1.0),
        ("d", "d", 4.0),
        ("d", "c", 3.0),
    ]
    hosts = sorted({h for e in edges for h in e[:2]})
    m = np.zeros((len(hosts), len(hosts)))
    for s, d, w in edges:
        m[hosts.index(d), hosts.index(s)] = w / sum(x for t, _, x in edges if t == s)
    seed = np.array([float(h == "a") for h in hosts])
    want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, 0.15 * seed)
    df, seeds = spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 5.0)], "host string, seed double")
    got = {r.host: r.score for r in url_filter.propagate(df, seeds, Scratch(spark, "t"), "x").collect()}
    assert sum(abs(got[h] - x) for h, x in zip(hosts, want, strict=True)) <= 1e-6


def test_dangling_mass_returns_to_the_seeds(spark, brisk):
    """Against a matrix whose rows without out-edges are the seeds."""
    edges = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "b", 1.0), ("b", "d", 1.0), ("e", "a", 1.0)]
    hosts = list("abcde")
    m = np.zeros((5, 5))
    for s, d, w in edges:
        m[hosts.index(d), hosts.index(s)] = w / sum(x for t, _, x in edges if t == s)
    seed = np.array([0.75, 0, 0, 0, 0.25])
    for k, h in enumerate(hosts):
        if not any(t == h for t, _, _ in edges):
            m[:, k] = seed
    want = np.linalg.solve(np.eye(5) - 0.85 * m, 0.15 * seed)
    df, seeds = spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(
        [("a", 3.0), ("e", 1.0)],
        "host string, seed double",
    )
    got = {r.host: r.score for r in url_filter.propagate(df, seeds, Scratch(spark, "t"), "x").collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and sum(abs(got.get(h, 0) - x) for h, x in zip(hosts, want, strict=True)) <= 1e-6


def test_many_hosts_change_no_verdict(spark, brisk):
    """Seeds elsewhere hold all but a billionth of a billionth of the mass; scores here stay right, relative to each other."""
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("b", "d", 3.0), ("big", "big", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    score = lambda seeds: {r.host: r.score for r in url_filter.propagate(df, spark.createDataFrame(seeds, "host string, seed double"), Scratch(spark, "t"), "x").collect()}
    alone, beside = score([("a", 1.0)]), score([("a", 1.0), ("big", 1e18)])
    assert 0 < beside["d"] < 1e-18 and beside.keys() == alone.keys() | {"big"}
    for h in "bcd":
        assert beside[h] / beside["a"] == pytest.approx(alone[h] / alone["a"], rel=1e-6)


def test_equal_scores_allow_whatever_the_order_of_sums(spark):
    """A host between a good and a bad one, in the same way: neither side outweighs the other."""
    link = lambda *to: "".join(f'<a href="http://{t}/">' for t in to)
    rows = [(1, "http://good.com/", link("m.com")), (2, "http://m.com/", link("bad.com")), (3, "http://bad.com/", ""), (4, "http://m.com/x", link("bad.com")), (None, "http://m.com/", None)]
    got = url_filter.judge(spark.createDataFrame(rows, PAGES), RULES).collect()
    assert {(r.page_id, r.verdict) for r in got if r.host == "m.com"} == {(2, "allow"), (4, "allow"), (None, "allow")}


def test_relative_links_are_loops_and_other_schemes_none(spark):
    html = """<a href=/x><a HREF = 'y?z'><img src="//i.net/p"><a href="https://B.org/q"><a href="mailto:a@c.org"><a href='#top'><a href="""  + " " * 200_000 + ">"
    got = {
        (r.src, r.dst): r.weight for r in url_filter.host_edges(
            spark.createDataFrame([(1, "http://a.com/", html), (2, None, html), (3, "http://z.com/", None)], PAGES)
        ).collect()
    }
    assert got == {("a.com", "a.com"): 3.0, ("a.com", "i.net"): 1.0, ("a.com", "b.org"): 1.0}


def test_rules_of_equal_length(spark):
    """Of rules of one length the longer host wins; of equal hosts the later one in code point order."""
    rules = [("block", "a.com", "/x"), ("allow", "b.a.com", ""), ("block", "c.org", "/y"), ("allow", "c.org", "/y")]
    got = {
        r.page_id: (r.rule, r.verdict) for r in url_filter.judge(
            spark.createDataFrame([(1, "http://b.a.com/x", ""), (2, "http://c.org/y", "")], PAGES),
            rules,
        ).collect()
    }
    assert got == {1: ("b.a.com", "allow"), 2: ("c.org/y", "block")}


@pytest.mark.parametrize("hierarchy,far", [(False, "allow"), (True, "block")])
def test_ties_to_parents_are_a_choice(spark, brisk, hierarchy, far):
    rows = [(1, "http://www.bad.com/", ""), (2, "http://blog.bad.com/q", "")]
    got = {
        r.page_id: r.verdict for r in url_filter.judge(
            spark.createDataFrame(rows, PAGES),
            [("block", "www.bad.com", "/")],
            hierarchy=hierarchy,
        ).collect()
    }
    assert got == {1: "block", 2: far}
