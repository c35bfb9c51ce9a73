"""Automation risk: of a comment in its batch, of a user, and the 0-100 rule score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.text import URL, collapse_key, is_present, link_density, words

BURST_SECONDS, BURST_ROWS = 60, 3
FLAG = 0.7
REFERENCE_SECONDS = 3600.0
LEAST_INTERACTIONS = 3


def comment_risk(comments: DataFrame) -> DataFrame:
    """Adds duplicate, burst and link scores and automation_risk_score to (content_id, batch, author, ts, text).

    A batch is a parent thread. The burst looks at a row and the two before it of
    the same author, and counts those within a minute. Rows without an id score nothing.
    """
    rows = comments.filter(is_present(F.col("content_id").cast("string")))
    key = F.when(is_present(F.col("text")), collapse_key(F.col("text")))
    batch = F.coalesce(F.nullif(F.col("batch"), F.lit("")), F.lit("__no_parent__"))
    keyed = rows.withColumns({"__batch": batch, "__key": key})
    counts = keyed.filter(F.col("__key").isNotNull()).groupBy("__batch", "__key").agg(F.count("*").alias("__same"))
    joined = keyed.join(counts, ["__batch", "__key"], "left")
    timed = is_present(F.col("author")) & F.col("ts").isNotNull()
    recent = Window.partitionBy("__batch", "author", timed).orderBy("ts", "content_id").rowsBetween(-(BURST_ROWS - 1), 0)
    seconds = F.unix_seconds("ts")
    near = F.size(F.filter(F.collect_list(seconds).over(recent), lambda t: F.unix_seconds("ts") - t <= BURST_SECONDS))
    duplicate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce("__same", F.lit(1)) - 1) / 4))
    burst = F.when(timed, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (near - 1) / BURST_ROWS))).otherwise(0.0)
    out = joined.withColumns({"duplicate_score": duplicate, "burst_score": burst, "link_score": link_density(F.col("text"))})
    # Rounded to 10 places first: sums that differ in their last bit only must not part at a tie.
    score = 0.5 * F.col("duplicate_score") + 0.35 * F.col("burst_score") + 0.15 * F.col("link_score")
    return out.withColumn("automation_risk_score", F.round(F.round(F.least(F.lit(1.0), score), 10), 4)).drop("__batch", "__key", "__same")


def _ten_thousandths(c: Column) -> Column:
    return F.round(c * 10_000).cast("long")


def user_features(comments: DataFrame) -> DataFrame:
    """Features, score and flag of each author of (author, content_id, post_id, is_reply, ts, text, likes, automation_risk_score)."""
    rows = comments.filter(is_present(F.col("author")))
    order = Window.partitionBy("author").orderBy(F.asc_nulls_last("ts"), "content_id")
    gap = F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(order)
    has_text = F.length(F.coalesce("text", F.lit(""))) > 0
    key = F.when(has_text, collapse_key(F.col("text")))
    # Both windows and the final aggregate are by author: one shuffle.
    prepared = rows.withColumns({"__gap": gap, "__key": key}).withColumn("__same", F.count("__key").over(Window.partitionBy("author", "__key")))
    n, texts = F.count("*"), F.count("__key")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    hours = F.count_distinct(F.hour("ts"))
    users = prepared.groupBy("author").agg(
        n.alias("total_interactions"),
        F.count_distinct("post_id").alias("posts_participated"),
        F.count_if("is_reply").alias("replies"),
        F.round(ratio(F.count_if("is_reply"), n), 4).alias("reply_ratio"),
        F.round(F.avg(F.size(words(F.col("text")))), 2).alias("mean_word_count"),
        F.percentile(F.size(words(F.col("text"))), F.lit(0.5)).alias("median_word_count"),
        F.round(F.avg(F.coalesce("likes", F.lit(0.0))), 2).alias("mean_like_count"),
        F.round(ratio(F.count_if(F.coalesce(F.col("text").rlike(URL), F.lit(False))), n), 4).alias("url_interaction_ratio"),
        F.round(ratio(F.count_if(F.col("__key").isNotNull() & (F.col("__same") > 1)), texts), 4).alias("exact_duplicate_ratio"),
        F.round(ratio(F.count_distinct("__key"), texts), 4).alias("unique_text_ratio"),
        F.percentile("__gap", F.lit(0.5)).alias("median_interarrival_seconds"),
        F.round(ratio(F.count_if(F.col("__gap") <= BURST_SECONDS), F.count("__gap")), 4).alias("rapid_activity_ratio_60s"),
        hours.alias("active_utc_hours"),
        F.round(hours / 24, 4).alias("hour_coverage_ratio"),
        # Scores have four places: a mean of whole ten-thousandths rounds alike in any order of the rows.
        (F.floor((2 * F.sum(_ten_thousandths(F.col("automation_risk_score"))) + F.count("automation_risk_score")) / (2 * F.nullif(F.count("automation_risk_score"), F.lit(0)))) / 10_000).alias("mean_comment_level_automation_risk"),
        F.min("ts").alias("first_activity_utc"),
        F.max("ts").alias("last_activity_utc"),
    )
    c = F.col
    parts = {"exact_duplicate_ratio": 35, "rapid_activity_ratio_60s": 25, "url_interaction_ratio": 15, "hour_coverage_ratio": 10, "mean_comment_level_automation_risk": 15}
    # Weights have two places and parts four, so the score is a whole number of millionths; rounded half up.
    millionths = sum((w * _ten_thousandths(F.coalesce(c(p), F.lit(0.0))) for p, w in parts.items()), F.lit(0))
    score = F.floor((F.least(F.lit(1_000_000), millionths) + 50) / 100) / 10_000
    return users.withColumn("automation_risk_score_user", score).withColumn("is_flagged_bot_suspect", F.col("automation_risk_score_user") >= FLAG)


def response_times(comments: DataFrame) -> DataFrame:
    """Each comment with its parent's author: seconds to respond, and whether it answers its own author."""
    parents = comments.select(F.col("content_id").alias("parent_comment_id"), F.col("ts").alias("parent_ts"), F.col("author").alias("parent_author"))
    joined = comments.join(parents, "parent_comment_id", "left")
    return joined.withColumn("response_seconds", F.unix_seconds("ts") - F.unix_seconds("parent_ts")).withColumn("is_self_reply", F.coalesce(F.col("author") == F.col("parent_author"), F.lit(False)))


def evidence_level(n: Column) -> Column:
    """Right-closed bins of the number of interactions."""
    return F.when(n <= 2, "insufficient").when(n <= 4, "low").when(n <= 9, "medium").otherwise("high")


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rule_score(users: DataFrame) -> DataFrame:
    """Eight weighted parts, the 0-100 score and its group, of a user table.

    Needs user_key, total_interactions, posts_participated, replies, exact_duplicate_ratio, unique_text_ratio,
    median_interarrival_seconds, median_response_time_seconds, very_fast_reply_ratio_60s, url_interaction_ratio,
    hour_coverage_ratio, self_reply_ratio and mean_lexical_diversity.
    """
    c = F.col
    quantiles = F.broadcast(users.agg(F.percentile("mean_lexical_diversity", F.lit(0.5)).alias("__median")))
    filled = users.crossJoin(quantiles).withColumn("mean_lexical_diversity", F.coalesce("mean_lexical_diversity", "__median"))
    spread = F.broadcast(filled.agg(F.percentile("mean_lexical_diversity", F.array(F.lit(0.1), F.lit(0.5))).alias("__q"), F.count("*").alias("__n")))
    # The average rank of a value, from counts by value: no window over all users.
    per = users.groupBy(F.coalesce("posts_participated", F.lit(0)).alias("__posts")).agg(F.count("*").alias("__k"))
    ranked = per.withColumn("__rank", F.sum("__k").over(Window.orderBy("__posts")) - (F.col("__k") - 1) / 2)
    base = filled.crossJoin(spread).withColumn("__posts", F.coalesce("posts_participated", F.lit(0))).join(ranked.select("__posts", "__rank"), "__posts")
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    quick = lambda name: 1 - F.least(F.greatest(F.coalesce(name, F.lit(REFERENCE_SECONDS)).cast("double"), F.lit(0.0)), F.lit(REFERENCE_SECONDS)) / REFERENCE_SECONDS
    q10, q50 = c("__q")[0], c("__q")[1]
    parts = {
        "duplicate_score": _unit(0.7 * _unit(zero("exact_duplicate_ratio")) + 0.3 * (1 - _unit(F.coalesce("unique_text_ratio", F.lit(1.0))))),
        "fast_reply_score": F.when(F.coalesce("replies", F.lit(0)) == 0, 0.0).otherwise(_unit(0.7 * _unit(zero("very_fast_reply_ratio_60s")) + 0.3 * quick("median_response_time_seconds"))),
        "rapid_activity_score": F.when(c("total_interactions") <= 1, 0.0).otherwise(_unit(quick("median_interarrival_seconds"))),
        "continuous_activity_score": _unit(_unit(zero("hour_coverage_ratio")) * _unit(c("total_interactions") / 20)),
        "url_score": _unit(zero("url_interaction_ratio")),
        "low_diversity_score": F.coalesce(_unit((q50 - c("mean_lexical_diversity")) / F.greatest(q50 - q10, F.lit(1e-9))), F.lit(0.0)),
        "self_reply_score": _unit(zero("self_reply_ratio")),
        "multi_post_activity_score": _unit(c("__rank") / c("__n")),
    }
    weights = (25, 15, 15, 10, 10, 10, 5, 10)
    scored = base.withColumns(parts)
    total = sum((w * c(p) for w, p in zip(weights[1:], list(parts)[1:], strict=True)), weights[0] * c("duplicate_score"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))
    group = F.when(c("rule_score") <= 20, "low_risk").when(c("rule_score") <= 50, "review_low").when(c("rule_score") <= 75, "review_high").otherwise("high_risk")
    enough = c("total_interactions") >= LEAST_INTERACTIONS
    out = scored.withColumn("rule_score", F.round(score, 6)).withColumn("rule_risk_group", group)
    return out.select("user_key", *[F.round(p, 6).alias(p) for p in parts], "rule_score", "rule_risk_group", evidence_level(c("total_interactions")).alias("evidence_level"), F.when(enough, c("rule_risk_group")).otherwise("insufficient_evidence").alias("final_rule_status"))


def review_samples(scored: DataFrame, n: int = 30) -> DataFrame:
    """The n highest, lowest and nearest to the median score, each in order."""
    median = F.broadcast(scored.agg(F.percentile("rule_score", F.lit(0.5)).alias("__m")))
    top = scored.orderBy(F.desc("rule_score"), "user_key").limit(n).withColumn("sample", F.lit("highest"))
    low = scored.orderBy("rule_score", "user_key").limit(n).withColumn("sample", F.lit("lowest"))
    mid = scored.crossJoin(median).orderBy(F.abs(F.col("rule_score") - F.col("__m")), "user_key").limit(n).drop("__m").withColumn("sample", F.lit("median"))
    return top.unionByName(low).unionByName(mid).select("sample", "user_key", "rule_score")
