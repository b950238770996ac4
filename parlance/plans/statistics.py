"""Queries over result rows: systems are return flags, items customers, groups nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import statistics as st

LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, system, cond, status, words, errors) of every line item."""
    words = F.floor("l_quantity").cast("long")
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_returnflag").alias("system"),
        F.col("l_linestatus").alias("status"),
        words.alias("words"),
        (F.floor("l_extendedprice").cast("long") % (words + 1)).alias("errors"),
        F.col("l_linenumber").alias("line"),
    )
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("item"),
        F.col("o_orderpriority").alias("cond"),
    )
    return lines.join(orders, "l_orderkey")


FACTS = """WITH facts AS (SELECT l_orderkey, o_custkey AS item, l_returnflag AS system, o_orderpriority AS cond, l_linestatus AS status, l_linenumber AS line, floor(l_quantity)::BIGINT AS words, floor(l_extendedprice)::BIGINT % (floor(l_quantity)::BIGINT + 1) AS errors FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
per AS (SELECT item, system, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words FROM facts GROUP BY ALL)
"""


def _per_item(f: DataFrame) -> DataFrame:
    return f.groupBy("item", "system").agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"))


def pooled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rate and mean of the items' own rates for each system."""
    per = _per_item(facts(spark, sf_dir))
    return per.groupBy("system").agg(
        F.sum("errors").alias("errors"),
        F.sum("words").alias("words"),
        F.round(st.pooled_rate("errors", "words"), 6).alias("pooled"),
        F.round(F.avg(F.col("errors") / F.greatest("words", F.lit(1))), 6).alias("macro"),
        F.count_distinct("item").alias("items"),
    )


def condition_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rate by system and condition, conditions as columns in a fixed order."""
    out = facts(spark, sf_dir).groupBy("system").pivot("cond", LEVELS).agg(F.round(st.pooled_rate("errors", "words"), 6))
    return out.select("system", *(F.col(f"`{c}`").alias(f"p{c[0]}") for c in LEVELS))


def rollup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by system and status with subtotals and the total in one pass."""
    f = facts(spark, sf_dir)
    out = f.rollup("system", "status").agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"), F.count("*").alias("n"))
    return out.select(F.coalesce("system", F.lit("all")).alias("system"), F.coalesce("status", F.lit("all")).alias("status"), "errors", "words", "n")


def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems A and R on the items that have both: mean difference, and who is better how often."""
    wide = _per_item(facts(spark, sf_dir)).withColumn(
        "rate",
        F.col("errors") / F.greatest("words", F.lit(1)),
    ).groupBy("item").pivot("system", ["A", "R"]).agg(F.first("rate"))
    both = wide.where("A is not null and R is not null")
    return both.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("A") - F.col("R")), 6).alias("mean_diff"),
        F.count_if(F.col("A") < F.col("R")).alias("helped"),
        F.count_if(F.col("A") > F.col("R")).alias("hurt"),
    )


#: The reference's count for items; groups take twice as many.
RESAMPLES = 2000
PLAIN_RESAMPLES = 5000


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the pooled rate of system A by resampling items."""
    per = _per_item(facts(spark, sf_dir)).where("system = 'A'")
    return st.interval(st.resampled(per, "item", "errors", "words", RESAMPLES))


def group_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the pooled rate of system N by resampling whole nations, and how many nations are worse than the mean."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("grp"))
    per = _per_item(facts(spark, sf_dir)).where("system = 'N'").join(customers, "item").groupBy("grp").agg(
        F.sum("errors").alias("errors"),
        F.sum("words").alias("words"),
    )
    rates = st.interval(st.resampled(per, "grp", "errors", "words", 2 * RESAMPLES))
    whole = per.agg(F.sum("errors").alias("te"), F.sum("words").alias("tw"))  # one row
    totals = per.crossJoin(F.broadcast(whole))
    worse = totals.agg(F.count_if(F.col("errors") * F.col("tw") > F.col("te") * F.col("words")).alias("worse"), F.count("*").alias("groups"))
    return rates.withColumn("k", F.lit(1)).join(worse.withColumn("k", F.lit(1)), "k").drop("k")


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, d): rate of system A less that of R on the items that have both."""
    wide = _per_item(facts(spark, sf_dir)).withColumn(
        "rate",
        F.col("errors") / F.greatest("words", F.lit(1)),
    ).groupBy("item").pivot("system", ["A", "R"]).agg(F.first("rate"))
    return wide.where("A is not null and R is not null").select("item", (F.col("A") - F.col("R")).alias("d"))


def _difference_interval(d: DataFrame, resamples: int) -> DataFrame:
    """(mean_diff, lo, hi, resamples) of (item, d), items resampled."""
    rates = st.interval(st.resampled(d.withColumn("one", F.lit(1)), "item", "d", "one", resamples))
    return d.agg(F.round(F.avg("d"), 6).alias("mean_diff")).crossJoin(rates)  # one row each


def paired_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of systems A and R with its interval by resampling items."""
    return _difference_interval(_differences(spark, sf_dir), RESAMPLES)


def plain_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``paired_diff_ci`` with the 5,000 resamples of the speaker count evaluation."""
    return _difference_interval(_differences(spark, sf_dir), PLAIN_RESAMPLES)


def group_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of systems A and R with its interval by resampling whole nations, and in how many nations A is worse."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("grp"))
    groups = _differences(spark, sf_dir).join(customers, "item").groupBy("grp").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    rates = st.interval(st.resampled(groups, "grp", "d", "n", 2 * RESAMPLES))
    totals = groups.agg(
        F.round(F.sum("d") / F.sum("n"), 6).alias("mean_diff"),
        F.count_if(F.col("d") > 0).alias("worse"),
        F.count("*").alias("groups"),
    )
    return totals.crossJoin(rates).select("mean_diff", "lo", "hi", "resamples", "worse", "groups")


def grid_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best discount setting of each system by pooled rate, then spread, and its rate at the default setting."""
    lines = _table(spark, sf_dir, "lineitem")
    words = F.floor("l_quantity").cast("long")
    g = lines.select(
        F.col("l_returnflag").alias("system"),
        F.round(F.col("l_discount") * 100).cast("long").alias("setting"),
        words.alias("words"),
        (F.floor("l_extendedprice").cast("long") % (words + 1)).alias("errors"),
    )
    rates = g.groupBy("system", "setting").agg(F.round(st.pooled_rate("errors", "words"), 6).alias("rate"), F.max("errors").alias("spread"))
    best = rates.groupBy("system").agg(
        F.min(F.struct("rate", "spread", "setting")).alias("b"),
        F.max(F.when(F.col("setting") == 0, F.col("rate"))).alias("default_rate"),
    )
    return best.select(
        "system",
        F.col("b.setting").alias("setting"),
        F.col("b.rate").alias("rate"),
        F.col("b.spread").alias("spread"),
        "default_rate",
    )


def median_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median order of each priority by price."""
    o = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return st.upper_median_rows(o, "o_orderpriority", ["o_totalprice", "o_orderkey"])


def anti_join_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order, in the segments of those with one."""
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey")
    )
    busy = c.join(o, "c_custkey", "left_semi").select("c_mktsegment").distinct()
    return c.join(o, "c_custkey", "left_anti").join(busy, "c_mktsegment", "left_semi").select("c_custkey", "c_mktsegment")


def stage_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, largest and pooled factor of each system and status, and the share of lines without errors."""
    f = facts(spark, sf_dir)
    return f.groupBy("system", "status").agg(
        F.count("*").alias("n"),
        F.sum("words").alias("words"),
        F.max("errors").alias("most"),
        F.round(F.avg("errors"), 6).alias("mean"),
        F.round(F.try_divide(F.sum("errors"), F.sum("words")), 6).alias("factor"),
        F.round(F.avg((F.col("errors") == 0).cast("double")), 6).alias("exact_share"),
    )


def two_run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices against the sums of their lines: matched, equal in status, and the range of the difference."""
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.floor("l_extendedprice").cast("long")).alias("price_b"),
        F.max("l_linestatus").alias("status_b"),
    )
    j = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.floor("o_totalprice").cast("long").alias("price_a"),
        F.col("o_orderstatus").alias("status_a"),
    ).join(lines, "o_orderkey")
    d = F.col("price_b") - F.col("price_a")
    return j.groupBy("status_a").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status_a") == F.col("status_b")).alias("same_status"),
        F.min(d).alias("least"),
        F.max(d).alias("most"),
        F.round(F.avg(d), 3).alias("mean"),
    )


def design_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the duration band with text, outside the tuning source, and how many are short."""
    d = _table(spark, sf_dir, "documents").where(
        (F.length("text").between(100, 2000)) & (F.trim("text") != "") & (F.coalesce("source", F.lit("")) != "src7")
    )
    return d.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.count_if(F.length("text") < 300).alias("short"),
        F.count_if(F.col("lang").isin("en", "de") & (F.col("n_chars") > 1000)).alias("long_pair"),
    )


def policy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rate and separated share by status and system, with urgent and low conditions beside, and empty results counted."""
    f = facts(spark, sf_dir)
    main = f.groupBy("status", "system").agg(
        F.round(st.pooled_rate("errors", "words"), 6).alias("rate"),
        F.round(F.avg((F.col("line") > 3).cast("double")), 6).alias("share"),
        F.count_if(F.col("errors") == 0).alias("empty"),
    )
    wide = f.groupBy("status", "system").pivot("cond", ["1-URGENT", "5-LOW"]).agg(F.round(st.pooled_rate("errors", "words"), 6))
    return main.join(wide, ["status", "system"]).select(
        "status",
        "system",
        "rate",
        "share",
        "empty",
        F.col("`1-URGENT`").alias("urgent"),
        F.col("`5-LOW`").alias("low"),
    )


def conversation_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides with two lines or more and at least 300 characters, with their first line."""
    c = _table(spark, sf_dir, "conversations").where("length(text) > 0")
    g = c.groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("first"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return g.where("n >= 2 and chars >= 300").select("conv_id", "role", F.length("first").cast("long").alias("first_chars"), "n", "chars")


def busiest_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 customers with the most words over all systems: a top-k report."""
    return facts(spark, sf_dir).groupBy("item").agg(F.sum("words").alias("words")).orderBy(F.desc("words"), "item").limit(20)


def _fifth_sql(name: str, of: str) -> str:
    """Columns that end in ``name``: the fifth power of ``of`` modulo the prime of the draws."""
    p = st.PRIME
    return f"({of}) % {p} AS {name}1, {name}1 * {name}1 % {p} AS {name}2, ({name}2 * {name}2 % {p}) * {name}1 % {p} AS {name}"


def _uniforms_sql(rows: str, stream: str, place: str) -> str:
    """``rows`` (b and what ``stream`` and ``place`` read) with u, as ``statistics.uniforms`` has it."""
    o = st.OFFSETS
    keys = ", ".join(_fifth_sql(n, x) for n, x in (("fa", f"b + {o[0]}"), ("ga", f"{stream} + {o[1]}"), ("fb", f"b + {o[2]}"), ("gb", f"{stream} + {o[3]}"), ("ka", "fa + ga"), ("kb", "fb + gb")))
    return f"SELECT *, {keys}, {_fifth_sql('start', f'{place} + {o[4]}')}, {_fifth_sql('mid', 'start + ka')}, {_fifth_sql('u', 'mid + kb')} FROM {rows}"


def _boot_sql(items: str, key: str, resamples: int) -> str:
    return f""", num AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS i, count(*) OVER () AS n, greatest({st.BLOCK}, (count(*) OVER () + {st.MOST_BLOCKS - 1}) // {st.MOST_BLOCKS}) AS size FROM {items}),
whole AS (SELECT DISTINCT n, size FROM num),
first AS ({_uniforms_sql(f"(SELECT n, size, b::BIGINT AS b, d // {1 << 20} AS strip, d % {1 << 20} AS place FROM whole, generate_series(0, {resamples - 1}) t(b), generate_series(0, n - 1) s(d))", "2 * strip + 1", "place")}),
chosen AS (SELECT n, size, b, CASE WHEN n > size THEN u * n // {st.PRIME} // size ELSE 0 END AS blk, strip, place FROM first),
placed AS (SELECT n, size, b, blk, row_number() OVER (PARTITION BY b, blk ORDER BY strip, place) - 1 AS j FROM chosen),
dr AS (SELECT b, blk * size + u % least(size, n - blk * size) AS i FROM ({_uniforms_sql("placed", "2 * blk", "j")})),
rt AS (SELECT b, sum(errors) / greatest(sum(words), 1) AS rate FROM dr JOIN num USING (i) GROUP BY b),
ci AS (SELECT round(quantile_cont(rate, 0.025), 6) AS lo, round(quantile_cont(rate, 0.975), 6) AS hi, count(*) AS resamples FROM rt)
"""


#: Differences of systems A and R by item; ``errors`` over ``words`` is then their mean.
_DIFF_SQL = ", own AS (SELECT a.item, a.errors / greatest(a.words, 1) - r.errors / greatest(r.words, 1) AS errors, 1 AS words FROM per a JOIN per r ON a.item = r.item AND a.system = 'A' AND r.system = 'R')"
_RATE = "round(sum(errors) / greatest(sum(words), 1), 6)"
QUERIES = {
    f.__name__: f for f in (
        pooled_rates,
        condition_crosstab,
        rollup_summary,
        paired_diff,
        bootstrap_ci,
        group_bootstrap,
        paired_diff_ci,
        plain_diff_ci,
        group_diff_ci,
        grid_argmin,
        median_row,
        anti_join_speakers,
        stage_benchmark,
        two_run_compare,
        design_filters,
        policy_compare,
        conversation_sides,
        busiest_recordings,
    )
}
ORACLES = {
    "pooled_rates": FACTS + f"SELECT system, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, {_RATE} AS pooled, round(avg(errors / greatest(words, 1)), 6) AS macro, count(DISTINCT item) AS items FROM per GROUP BY system",
    "condition_crosstab": FACTS + "SELECT system, " + ", ".join(
        f"round(sum(errors) FILTER (cond = '{c}') / greatest(sum(words) FILTER (cond = '{c}'), 1), 6) AS p{c[0]}" for c in LEVELS
    ) + " FROM facts GROUP BY system",
    "rollup_summary": FACTS + "SELECT coalesce(system, 'all') AS system, coalesce(status, 'all') AS status, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, count(*) AS n FROM facts GROUP BY GROUPING SETS ((system, status), (system), ())",
    "paired_diff": FACTS + ", w AS (SELECT a.errors / greatest(a.words, 1) AS a, r.errors / greatest(r.words, 1) AS r FROM per a JOIN per r ON a.item = r.item AND a.system = 'A' AND r.system = 'R') SELECT count(*) AS n, round(avg(a - r), 6) AS mean_diff, count(*) FILTER (a < r) AS helped, count(*) FILTER (a > r) AS hurt FROM w",
    "bootstrap_ci": FACTS + ", own AS (SELECT * FROM per WHERE system = 'A')" + _boot_sql("own", "item", RESAMPLES) + "SELECT * FROM ci",
    "group_bootstrap": FACTS + ", own AS (SELECT c_nationkey AS grp, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words FROM per JOIN customer ON c_custkey = item WHERE system = 'N' GROUP BY 1)" + _boot_sql(
        "own",
        "grp",
        2 * RESAMPLES,
    ) + "SELECT ci.*, (SELECT count(*) FROM own WHERE errors * (SELECT sum(words) FROM own) > words * (SELECT sum(errors) FROM own)) AS worse, (SELECT count(*) FROM own) AS groups FROM ci",
    "paired_diff_ci": FACTS + _DIFF_SQL + _boot_sql(
        "own",
        "item",
        RESAMPLES,
    ) + "SELECT (SELECT round(avg(errors), 6) FROM own) AS mean_diff, ci.* FROM ci",
    "plain_diff_ci": FACTS + _DIFF_SQL + _boot_sql(
        "own",
        "item",
        PLAIN_RESAMPLES,
    ) + "SELECT (SELECT round(avg(errors), 6) FROM own) AS mean_diff, ci.* FROM ci",
    "group_diff_ci": FACTS
    + _DIFF_SQL
    + ", g AS (SELECT c_nationkey AS grp, sum(errors) AS errors, count(*) AS words FROM own JOIN customer ON c_custkey = item GROUP BY 1)"
    + _boot_sql("g", "grp", 2 * RESAMPLES)
    + "SELECT (SELECT round(sum(errors) / sum(words), 6) FROM g) AS mean_diff, ci.*, (SELECT count(*) FROM g WHERE errors > 0) AS worse, (SELECT count(*) FROM g) AS groups FROM ci",
    "grid_argmin": f"WITH g AS (SELECT l_returnflag AS system, round(l_discount * 100)::BIGINT AS setting, floor(l_quantity)::BIGINT AS words, floor(l_extendedprice)::BIGINT % (floor(l_quantity)::BIGINT + 1) AS errors FROM lineitem), r AS (SELECT system, setting, {_RATE} AS rate, max(errors) AS spread FROM g GROUP BY ALL) SELECT system, setting, rate, spread, max(rate) FILTER (setting = 0) OVER (PARTITION BY system) AS default_rate FROM r QUALIFY row_number() OVER (PARTITION BY system ORDER BY rate, spread, setting) = 1",
    "median_row": "WITH r AS (SELECT o_orderpriority, o_totalprice, o_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)) SELECT o_orderpriority, o_totalprice, o_orderkey FROM r WHERE i = n // 2",
    "anti_join_speakers": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))",
    "stage_benchmark": FACTS + "SELECT system, status, count(*) AS n, sum(words)::BIGINT AS words, max(errors) AS most, round(avg(errors), 6) AS mean, round(sum(errors) / sum(words), 6) AS factor, round(avg((errors = 0)::INT), 6) AS exact_share FROM facts GROUP BY ALL",
    "two_run_compare": "WITH b AS (SELECT l_orderkey AS o_orderkey, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS price_b, max(l_linestatus) AS status_b FROM lineitem GROUP BY 1), j AS (SELECT o_orderstatus AS status_a, status_b, price_b - floor(o_totalprice)::BIGINT AS d FROM orders JOIN b USING (o_orderkey)) SELECT status_a, count(*) AS n, count(*) FILTER (status_a = status_b) AS same_status, min(d) AS least, max(d) AS most, round(avg(d), 3) AS mean FROM j GROUP BY status_a",
    "design_filters": "SELECT lang, count(*) AS n, count(*) FILTER (length(text) < 300) AS short, count(*) FILTER (lang IN ('en', 'de') AND n_chars > 1000) AS long_pair FROM documents WHERE length(text) BETWEEN 100 AND 2000 AND trim(text) <> '' AND coalesce(source, '') <> 'src7' GROUP BY lang",
    "policy_compare": FACTS + f"SELECT status, system, {_RATE} AS rate, round(avg((line > 3)::INT), 6) AS share, count(*) FILTER (errors = 0) AS empty, " + ", ".join(
        f"round(sum(errors) FILTER (cond = '{c}') / greatest(sum(words) FILTER (cond = '{c}'), 1), 6) AS {n}" for c, n in (
            ("1-URGENT", "urgent"),
            ("5-LOW", "low"),
        )
    ) + " FROM facts GROUP BY ALL",
    "conversation_sides": "SELECT conv_id, role, length(arg_min(text, turn)) AS first_chars, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations WHERE length(text) > 0 GROUP BY ALL HAVING count(*) >= 2 AND sum(length(text)) >= 300",
    "busiest_recordings": FACTS + "SELECT item, sum(words)::BIGINT AS words FROM facts GROUP BY item ORDER BY words DESC, item LIMIT 20",
}
