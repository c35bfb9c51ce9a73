"""Sensitivity of the positive share: baseline against an alternative, by platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.stats import wilson_high, wilson_low
from weirflow.operators.trend import platforms

CONFIDENCE = 0.7
CAP_PERCENTILE = 0.99
WEIGHTED_PLATFORM = "youtube"


def _largest(ok: DataFrame, column: str, name: str) -> DataFrame:
    """The most frequent value of each platform: (count desc, value asc); one row a platform."""
    per = ok.filter(F.col(column).isNotNull()).groupBy("platform", column).agg(F.count("*").alias("n"))
    return F.broadcast(per.groupBy("platform").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(column).alias("v"))).alias("t")).select("platform", F.col("t.v").alias(name)))


def comparisons(records: DataFrame) -> DataFrame:
    """Six comparisons: all rules are flags on one scan, each alternative a conditional aggregate."""
    ok = records.filter(F.col("annotation_status") == "ok")
    flagged = ok.join(_largest(ok, "source_container", "top_source"), "platform", "left").join(_largest(ok, "post_id", "top_post"), "platform", "left")
    rules: dict[str, Column] = {
        "duplicate_inclusion": ~(F.coalesce("is_exact_duplicate", F.lit(False)) | F.coalesce("is_near_duplicate", F.lit(False))),
        "largest_source_exclusion": F.col("top_source").isNotNull() & ~F.coalesce(F.col("source_container") == F.col("top_source"), F.lit(False)),
        "largest_parent_exclusion": F.col("top_post").isNotNull() & ~F.coalesce(F.col("post_id") == F.col("top_post"), F.lit(False)),
        "confidence_threshold": F.coalesce(F.col("confidence") >= CONFIDENCE, F.lit(False)),
    }
    hit = F.col("sentiment_label") == "positive"
    aggs = [F.count("*").alias("n"), F.count_if(hit).alias("k")]
    aggs += [x for name, rule in rules.items() for x in (F.count_if(rule).alias(f"n_{name}"), F.count_if(rule & hit).alias(f"k_{name}"))]
    counts = F.broadcast(platforms(records)).join(flagged.groupBy("platform").agg(*aggs), "platform", "left")
    rows = [F.struct(F.lit(name).alias("comparison_id"), F.coalesce(f"n_{name}", F.lit(0)).alias("n_alternative"), F.coalesce(f"k_{name}", F.lit(0)).alias("k_alternative")) for name in rules]
    long = counts.select("platform", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"), F.explode(F.array(*rows)).alias("a")).select("platform", "n", "k", "a.*")
    n, k, na, ka = (F.col(c) for c in ("n", "k", "n_alternative", "k_alternative"))
    simple = long.select("comparison_id", "platform", n.alias("n_baseline"), F.try_divide(k, n).alias("share_b"), wilson_low(k, n).alias("low_b"), wilson_high(k, n).alias("high_b"), "n_alternative", F.try_divide(ka, na).alias("share_a"), wilson_low(ka, na).alias("low_a"), wilson_high(ka, na).alias("high_a"))

    # One author, one vote.
    per = ok.filter(F.col("author_hash").isNotNull()).groupBy("platform", "author_hash").agg((F.count_if(hit) / F.count("*")).alias("rate"))
    votes = per.groupBy("platform").agg(F.count("*").alias("na"), F.avg("rate").alias("ra"))
    base = counts.select("platform", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    none = F.lit(None).cast("double")
    left = [n.alias("n_baseline"), F.try_divide(k, n).alias("share_b"), wilson_low(k, n).alias("low_b"), wilson_high(k, n).alias("high_b")]
    balanced = base.join(votes, "platform", "left").select(F.lit("content_vs_author_balanced").alias("comparison_id"), "platform", *left, F.coalesce("na", F.lit(0)).alias("n_alternative"), F.col("ra").alias("share_a"), none.alias("low_a"), none.alias("high_a"))

    # Weights log1p of the capped engagement, on the platform that has it.
    scored = ok.filter((F.col("platform") == WEIGHTED_PLATFORM) & F.col("engagement_score").isNotNull()).withColumn("e", F.greatest("engagement_score", F.lit(0.0)))
    cap = F.broadcast(scored.agg(F.percentile("e", F.lit(CAP_PERCENTILE)).alias("cap")))
    w = F.log1p(F.least("e", "cap"))
    sums = scored.crossJoin(cap).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"), F.try_divide(F.sum(F.when(hit, w).otherwise(0.0)), F.sum(w)).alias("ws"))
    weighted = sums.select(F.lit("engagement_weighting").alias("comparison_id"), F.lit(WEIGHTED_PLATFORM).alias("platform"), *left, n.alias("n_alternative"), F.col("ws").alias("share_a"), none.alias("low_a"), none.alias("high_a"))

    r = lambda c: F.round(c, 6)
    return simple.unionByName(balanced).unionByName(weighted).select("comparison_id", "platform", "n_baseline", r("share_b").alias("positive_share_baseline"), r("low_b").alias("ci_low_baseline"), r("high_b").alias("ci_high_baseline"), "n_alternative", r("share_a").alias("positive_share_alternative"), r("low_a").alias("ci_low_alternative"), r("high_a").alias("ci_high_alternative"), r(F.col("share_a") - F.col("share_b")).alias("shift"))
