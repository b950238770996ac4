"""URL filters: address rules, and for the rest link-graph propagation, in DataFrame operations only.

Rules decide the addresses they fit. Every other address gets the verdict of its
host: trust flows from hosts with allowed addresses along host edges
(personalised PageRank), distrust flows from hosts with blocked addresses
against them. A host whose distrust exceeds ``ratio`` times its trust is blocked,
by more than ``MARGIN`` of it, so that the order of sums decides nothing. Scores
are compared as they are, never rounded, and both run until what is under way to
any host is small against that host's own score. So neither the number of hosts
nor the distance from a seed decides; only beyond some 4,000 links a score is
too small for a double.

Host edges are the hyperlinks of the pages: absolute and ``//`` links lead to
their host, relative ones back to the page's own. Only where ``hierarchy`` is
on, a host is also tied to its parent domain in both directions; unrelated sites
below one parent would then share their verdicts, so it is off by default.

Edge cases: a null address, or one without ``://``, has an empty host and path,
fits no rule and is allowed; a null page_id is kept; a null page has no links; links of other schemes
(``mailto:``, ``data:``) are none; a host without any edge or seed is allowed;
of fitting rules of equal length the one with the longer host wins, then the one
later in code point order; repeated pages count as often as they occur; extra
columns are ignored; a very long page is searched in linear time; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import skew
from parlance.llm.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of links; possessive, so that runs of white space are read once.
LINK = r"""(?i)\b(?:href|src)\s*+=\s*+["']?+\s*+([^"'\s>]+)"""
_ABSOLUTE, _SCHEME = r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//", r"^(?i)[a-z][a-z0-9+.-]*:"

#: Most rounds per written table.
_STEP = 8
#: Least relative difference of scores that counts.
MARGIN = 1e-9

Rule = tuple[str, str, str]  # verdict, host, path


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.element_at(F.split(url, "://", 2), 2)).otherwise("")


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(length, host_length, rule, verdict); null where none does."""
    each = [
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(
                F.lit(len(h) + len(p)).alias("length"),
                F.lit(len(h)).alias("host_length"),
                F.lit(h + p).alias("rule"),
                F.lit(v).alias("verdict"),
            ),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*each)))


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html", hierarchy: bool = False) -> DataFrame:
    """(src, dst, weight): counted links between hosts known by name; links inside a host are loops."""
    links = pages.select(
        host_of(F.col(url)).alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))).alias("to"),
    )
    named = host_of(F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("x:"), F.col("to"))).otherwise(F.col("to")))
    target = F.when(F.rlike("to", F.lit(_ABSOLUTE)), named).when(~F.rlike("to", F.lit(_SCHEME)), F.col("src"))
    edges = links.select("src", target.alias("dst"), F.lit(1.0).alias("weight"))
    if hierarchy:
        hosts = pages.select(host_of(F.col(url)).alias("host")).distinct()
        labels = F.split("host", r"\.")
        # A host and all domains above it with at least two labels; neighbours in that chain are tied.
        chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        chains = hosts.where(F.size(labels) >= 3).select(chain.alias("chain"))
        up = chains.select(
            F.explode(
                F.arrays_zip(
                    F.slice("chain", F.lit(1), F.size("chain") - 1).alias("low"),
                    F.slice("chain", F.lit(2), F.size("chain") - 1).alias("high"),
                )
            ).alias("e")
        ).select("e.low", "e.high").distinct()
        both = up.select(F.col("low").alias("src"), F.col("high").alias("dst")).unionByName(
            up.select(F.col("high").alias("src"), F.col("low").alias("dst"))
        )
        edges = edges.unionByName(both.withColumn("weight", F.lit(1.0)))
    return edges.where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(
    edges: DataFrame,
    seeds: DataFrame,
    scratch: Scratch,
    name: str,
    *,
    damping: float = 0.85,
    rounds: int | None = None,
    tolerance: float = 1e-7,
) -> DataFrame:
    """(host, score) of personalised PageRank from ``seeds`` (host, seed), or its state after ``rounds``.

    What arrives at a host passes its loops all at once, by their geometric sum;
    a part settles there, the rest moves on. What a host without out-edges
    cannot pass on returns to the seeds: that scales all scores alike, so it is
    done at the end by dividing by their sum. A score is what has settled on a
    host and what is still under way. Without ``rounds`` it ends when at each
    host the part under way is at most ``tolerance`` of its score and no further
    host was reached, which takes a round per link of the longest way and, with
    circles, a few dozen more.

    A round is one join and one aggregation on hosts; every few rounds are
    written, so that lineage stays flat.
    """
    out = edges.groupBy("src").agg(
        F.sum("weight").alias("out"),
        F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("loop"),
    )
    visits = 1 / (1 - F.col("loop") / F.col("out") * damping)
    share = edges.where("src <> dst").join(out, "src").select(
        "src",
        "dst",
        (F.col("weight") / F.col("out") * damping * visits).alias("share"),
        F.lit(0.0).alias("stay"),
    )
    # A row from a host to itself keeps what has settled, so that a round reads its input once.
    known = edges.select("src").union(edges.select("dst")).union(seeds.select("host")).distinct().join(out, "src", "left")
    stay = F.coalesce(visits, F.lit(1.0)) * (1 - damping)
    share = scratch.save(
        share.unionByName(known.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("share"), stay.alias("stay"))),
        f"{name}-share",
    )
    total = seeds.where("seed > 0").agg(F.sum("seed")).first()[0] or 1.0  # one number
    start = seeds.where("seed > 0").select("host", F.lit(0.0).alias("settled"), (F.col("seed") / F.lit(total)).alias("flow"))
    state = scratch.save(start, f"{name}-0")
    done, hosts, step = 0, -1, 1
    while rounds is None or done < rounds:
        under_way = F.max(F.when(F.col("flow") > 0, F.col("flow") / (F.col("flow") + F.col("settled"))))
        rest, reached = state.agg(F.coalesce(under_way, F.lit(0.0)), F.count("*")).first()  # two numbers
        if rounds is None and rest <= tolerance and reached == hosts:
            break
        hosts, last = reached, done
        now = state
        for _ in range(step if rounds is None else min(step, rounds - done)):
            moved = now.join(share, now["host"] == share["src"]).select(
                F.col("dst").alias("host"),
                F.when(F.col("stay") > 0, F.col("settled") + F.col("flow") * F.col("stay")).otherwise(0.0).alias("settled"),
                (F.col("flow") * F.col("share")).alias("flow"),
            )
            now = moved.groupBy("host").agg(F.sum("settled").alias("settled"), F.sum("flow").alias("flow"))
            done += 1
        state = scratch.save(now, f"{name}-{done}")
        scratch.drop(f"{name}-{last}")
        step = min(2 * step, _STEP)
    whole = state.agg(F.sum(F.col("settled") + F.col("flow"))).first()[0] or 1.0  # one number
    scratch.drop(f"{name}-share")
    return state.select("host", ((F.col("settled") + F.col("flow")) / F.lit(whole)).alias("score"))


def judge(
    pages: DataFrame,
    rules: list[Rule],
    *,
    ratio: float = 1.0,
    rounds: int | None = None,
    tolerance: float = 1e-7,
    hierarchy: bool = False,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by, trust, distrust) of each page.

    ``decided_by`` is rule, links (the host has a score) or nothing.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    named = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = scratch.save(
        named.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", "fit.verdict"),
        "ruled",
    )
    edges = scratch.save(host_edges(pages, url=url, html=html, hierarchy=hierarchy), "edges")
    seeds = ruled.where("verdict is not null").groupBy("host", "verdict").agg(F.count("*").cast("double").alias("seed"))
    seeds = scratch.save(seeds, "seeds")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    score = lambda e, verdict, name: propagate(
        e,
        seeds.where(F.col("verdict") == verdict).select("host", "seed"),
        scratch,
        name,
        rounds=rounds,
        tolerance=tolerance,
    ).select("host", F.col("score").alias(name))
    scores = scratch.save(score(edges, "allow", "trust").join(score(turned, "block", "distrust"), "host", "full"), "scores")
    # Hosts with very many pages are looked up without gathering these.
    sizes = ruled.groupBy("host").agg(F.count("*").alias("n"))
    common = sizes.where(F.col("n") > skew.limit(ruled, ruled.count())).join(scores, "host", "left")
    kept = ruled.withColumn("own", F.col("host"))
    found = skew.lookup(kept, scores, common, ["host"], ["trust", "distrust"], F.xxhash64("page_id", "path").cast("string"))
    joined = found.withColumnRenamed("own", "host").select(
        "page_id",
        "host",
        "path",
        "rule",
        "verdict",
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")),
    )
    method = F.when(F.col("distrust") > ratio * (1 + MARGIN) * F.col("trust"), "block").otherwise("allow")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("trust") + F.col("distrust") > 0, "links").otherwise("nothing")
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", method).alias("verdict"),
        by.alias("decided_by"),
        "trust",
        "distrust",
    )
