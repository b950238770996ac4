"""Checks of model-repaired transcripts, chunk planning and report reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text as tx

NOTES = {
    "rewrote": "the model rewrote this line instead of repairing it; ASR wording kept",
    "added": "the model added words that the ASR line does not contain; ASR wording kept",
    "dropped": "the model dropped words that the ASR line contains; ASR wording kept",
    "replaced": "the model replaced English words spoken in the line; ASR wording kept",
    "long": "the English is much longer than the line, so it may add things that were not said",
    "hard": "the model found this line hard to understand",
    "missing": "no English translation was returned",
    "same": "the same English was returned for different lines",
    "skipped": "the model skipped this line; ASR wording kept",
}


def first_replies(replies: DataFrame, keys: list[str]) -> DataFrame:
    """One reply per line: the first of duplicates by ``pos``."""
    rest = [c for c in replies.columns if c not in (*keys, "line_id")]
    return replies.groupBy(*keys, "line_id").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(*keys, "line_id", "r.*")


def unknown_ids(lines: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unknown): replies that name no line."""
    return replies.join(lines.select(*keys, "line_id"), [*keys, "line_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("unknown"))


def revert_reason(source: Column, text: Column, most: float = 0.5, loanwords: list[str] | None = None) -> Column:
    """Why a repair is not accepted, the first of the ordered checks that fails; null for an accepted one."""
    own = F.struct(
        tx.normalise(source).alias("form"),
        tx.normalise(text).alias("new"),
        tx.tokens(source).alias("said"),
        tx.tokens(text).alias("told"),
    )

    def judge(x: Column) -> Column:
        chars, others = (F.replace(x[c], F.lit(" "), F.lit("")) for c in ("form", "new"))
        # The distance ends at the most edits allowed, beyond which it is -1.
        edits = F.call_function("levenshtein", chars, others, F.floor(F.greatest(F.length(chars), F.lit(1)) * most).cast("int"))
        n_source, n_text = F.size(x["said"]), F.size(x["told"])
        reason = F.when(x["form"] == x["new"], F.lit(None).cast("string"))
        reason = reason.when(edits < 0, "rewrote")
        reason = reason.when(n_text - n_source > F.greatest(F.lit(1.0), F.rint(n_source * 0.2)), "added")
        reason = reason.when(n_text < F.size(tx.without_repeats(x["said"])), "dropped")
        if loanwords:
            known = F.array(*(F.lit(w) for w in loanwords))
            reason = reason.when(F.size(F.array_except(F.array_intersect(x["said"], known), x["told"])) > 0, "replaced")
        return reason

    return tx.bound(own, judge)


def check_replies(lines: DataFrame, replies: DataFrame, keys: list[str], *, most: float = 0.5, loanwords: list[str] | None = None) -> DataFrame:
    """Lines (keys, line_id, text) with the replies (line_id, text, english, uncertain, pos) that survive all checks.

    Lines without a usable reply keep their wording, are uncertain and say so.
    """
    reply = first_replies(replies, keys).select(
        *keys,
        "line_id",
        F.lit(True).alias("replied"),
        tx.collapse(F.col("text")).alias("new"),
        tx.collapse(F.col("english")).alias("en"),
        F.coalesce("uncertain", F.lit(False)).alias("flag"),
    )
    j = lines.join(reply, [*keys, "line_id"], "left").withColumn(
        "new",
        F.when(F.coalesce("new", F.lit("")) == "", F.col("text")).otherwise(F.col("new")),
    )
    en = F.when(F.rlike(F.coalesce("en", F.lit("")), F.lit(tx.INDIC)), "").otherwise(F.coalesce("en", F.lit("")))
    j = j.withColumn("en", en).withColumn("reason", F.when(F.col("replied"), revert_reason(F.col("text"), F.col("new"), most, loanwords)))
    j = j.withColumn("out", F.when(F.col("replied") & F.col("reason").isNull(), F.col("new")).otherwise(F.col("text")))
    # One translation for several different lines translates none of them.
    same = j.where(F.size(tx.tokens(F.col("en"))) >= 3).groupBy(*keys, F.lower("en").alias("low")).agg(
        F.count_distinct(tx.normalise(F.col("text"))).alias("sources")
    ).where("sources > 1")
    marked = j.withColumn("low", F.lower("en")).join(same, [*keys, "low"], "left").withColumn("repeat", F.col("sources").isNotNull())
    long = F.length("en") > tx.longest_translation(F.col("text"))
    note = lambda when, key: F.when(when, F.lit(NOTES[key]))
    notes = F.concat_ws(
        "; ",
        *(note(F.col("reason") == k, k) for k in ("rewrote", "added", "dropped", "replaced")),
        note(F.col("replied") & long, "long"),
        note(F.col("flag"), "hard"),
        note(F.col("replied") & (F.col("en") == ""), "missing"),
        note(F.col("repeat"), "same"),
        note(F.col("replied").isNull(), "skipped"),
    )
    return marked.select(
        *keys,
        "line_id",
        F.col("out").alias("text"),
        F.col("text").alias("source_text"),
        F.when(F.col("repeat"), "").otherwise(F.col("en")).alias("english"),
        (F.col("out") != F.col("text")).alias("changed"),
        (notes != "").alias("uncertain"),
        "reason",
        tx.sentence(notes).alias("note"),
    )


def plan_chunks(lines: DataFrame, keys: list[str], budget: int, most: int = 6) -> DataFrame:
    """(keys, line_id, chunk): consecutive lines that fit the budget, at most ``most``; costs are in ``prompt`` and ``reply``.

    Greedy packing with a reset is no window function; it is a fold over each
    conversation's lines, in the JVM, which notes where chunks begin.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_id", (F.col("prompt") + F.col("reply")).alias("cost"))))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        fresh = (a["n"] == 0) | (a["used"] + x["cost"] + 220 > budget) | (a["n"] >= most)
        used, n = F.when(fresh, x["cost"]).otherwise(a["used"] + x["cost"]), F.when(fresh, 1).otherwise(a["n"] + 1)
        return F.struct(
            (a["at"] + 1).alias("at"),
            used.alias("used"),
            n.alias("n"),
            F.when(fresh, F.concat(a["starts"], F.array(a["at"]))).otherwise(a["starts"]).alias("starts"),
        )

    def numbered(p: Column) -> Column:
        upto = lambda k: F.coalesce(F.get(p["starts"], k + 1), F.size(p["lines"]))
        chunk = lambda s, k: F.transform(F.slice(p["lines"], s + 1, upto(k) - s), lambda x: F.struct(x["line_id"].alias("line_id"), k.alias("chunk")))
        return F.flatten(F.transform(p["starts"], chunk))

    per = lines.groupBy(*keys).agg(ordered.alias("lines"))
    pair = F.struct("lines", F.aggregate("lines", start, step)["starts"].alias("starts"))
    return per.select(*keys, F.inline(tx.bound(pair, numbered)))


def valid_actions(actions: DataFrame, lines: DataFrame, keys: list[str], owners: list[str], phrase: Column | None = None) -> DataFrame:
    """Actions (keys, pos, owner, action, ids) with a known owner, real evidence and a content word in common with it.

    ``phrase`` is the wording that has to be a commitment, where that is not the
    action itself: one without the words it only names.
    """
    blank = F.lower(tx.collapse(F.col("owner"))).isin("", "unspecified", "unknown", "none")
    a = actions.select(
        *keys,
        "pos",
        F.when(blank, "unspecified").otherwise(tx.collapse(F.col("owner"))).alias("owner"),
        tx.collapse(F.col("action")).alias("action"),
        (F.col("action") if phrase is None else phrase).alias("phrase"),
        F.explode(F.array_distinct("ids")).alias("line_id"),
    )
    a = a.where(~tx.is_non_commitment(tx.collapse(F.col("phrase"))) & F.col("owner").isin(*owners, "unspecified"))
    evidence = a.join(lines.select(*keys, "line_id", tx.tokens(F.col("text")).alias("said")), [*keys, "line_id"])
    shared = F.size(F.array_intersect(tx.content_tokens(F.col("action")), F.flatten(F.collect_list("said")))) > 0
    kept = evidence.groupBy(*keys, "pos", "owner", "action").agg(F.array_sort(F.collect_set("line_id")).alias("ids"), shared.alias("ok")).where("ok")
    first = F.row_number().over(W.partitionBy(*keys, "owner", F.lower("action")).orderBy("pos"))
    return kept.withColumn("_n", first).where("_n = 1").drop("_n", "ok")


def compatible(revision: str, model: str, context: int, default_model: str, default_context: int = 4096) -> Column:
    """Whether a cached report with columns revision, model and context may stand for a request."""
    of = lambda c, want, default: (F.col(c) == F.lit(want)) | (F.col(c).isNull() & F.lit(want == default))
    return F.coalesce(
        (F.col("revision").isNull() | (F.col("revision") == revision)) & of("model", model, default_model) & of("context", context, default_context),
        F.lit(False),
    )


def reuse_reports(requests: DataFrame, cache: DataFrame, usable: Column) -> DataFrame:
    """Requests (id, sha) with ``reused_from``, or as ``leader`` the first request of their text, which must be made."""
    ready = cache.where(usable).groupBy("sha").agg(F.min("report_id").alias("reused_from"))
    leaders = requests.groupBy("sha").agg(F.min("id").alias("leader"))
    return requests.join(ready, "sha", "left").join(leaders, "sha").select(
        "id",
        "reused_from",
        F.when(F.col("reused_from").isNull(), F.col("leader")).alias("leader"),
    )
