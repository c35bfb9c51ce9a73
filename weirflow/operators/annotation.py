"""Annotation: validating payloads, joining labels, measuring their quality, projecting cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.text import is_present, normalized, strip_fences

PAYLOAD = "sentiment string, stance string, emotion string, content_type string, confidence string, reason_code string"


def parse_payload(answer: Column, enums: dict[str, tuple[str, ...]]) -> tuple[Column, Column]:
    """A model's answer as a struct, and the first thing wrong with it (null if nothing).

    Confidence is a JSON number in 0..1, neither a string nor a boolean; the reason is not blank.
    """
    text = strip_fences(answer)
    payload = F.from_json(text, PAYLOAD, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(text).isNotNull() & payload.isNotNull() & text.startswith("{")
    error = F.when(~F.coalesce(valid, F.lit(False)), "json_parse_failure")
    for name, allowed in enums.items():
        error = error.when(~F.coalesce(payload[name].isin(*allowed), F.lit(False)), f"invalid_{name}")
    number = payload["confidence"].try_cast("double")
    # The JSON type counts: a quoted number is a string.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.confidence", "variant"))
    numeric = F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    error = error.when(~numeric | number.isNull() | (number < 0) | (number > 1), "invalid_confidence")
    return payload, error.when(~is_present(payload["reason_code"]), "blank_reason_code")


def bridge(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Eligible records with their annotations, one row per target; without any, pending_annotation.

    The near-duplicate flag is a cluster or a group of equal texts; the cluster falls back to that group.
    """
    labels = annotations.drop("platform")
    joined = records.join(labels, "content_id", "left")
    return joined.withColumn("annotation_status", F.coalesce("annotation_status", F.lit("pending_annotation"))).withColumn("is_near_duplicate", F.col("near_duplicate_cluster_id").isNotNull() | F.coalesce("duplicate_text_diff_id", F.lit(False))).withColumn("near_duplicate_cluster_id", F.coalesce("near_duplicate_cluster_id", "duplicate_text_group_id"))


def pending(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """Records still to annotate: only an ok attempt is done."""
    return records.join(attempts.filter("annotation_status = 'ok'").select("content_id").distinct(), "content_id", "left_anti")


def class_metrics(pairs: DataFrame, labels: tuple[str, ...], group: str = "route") -> DataFrame:
    """Per group and class: tp, fp, fn, precision, recall, F1, support; with the group's accuracy and macro-F1.

    The counts by (true, predicted) are all that is needed; macro-F1 is over classes with support.
    """
    cells = pairs.groupBy(group, "y_true", "y_pred").agg(F.count("*").alias("c"))
    long = cells.select(group, "c", F.explode(F.array_distinct(F.array("y_true", "y_pred"))).alias("label"), (F.col("y_true") == F.col("y_pred")).alias("hit"), "y_true")
    per = long.groupBy(group, "label").agg(F.sum(F.when(F.col("hit"), F.col("c")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("hit") & (F.col("label") == F.col("y_true")), F.col("c")).otherwise(0)).alias("fn"), F.sum(F.when(~F.col("hit") & (F.col("label") != F.col("y_true")), F.col("c")).otherwise(0)).alias("fp"))
    totals = cells.groupBy(group).agg(F.sum("c").alias("n"), F.round(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("accuracy"))
    classes = F.broadcast(pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string"))
    full = totals.crossJoin(classes).join(per, [group, "label"], "left").select(group, "n", "accuracy", "label", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    scored = full.withColumns({"precision": precision, "recall": recall, "support": tp + fn})
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    macro = F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))).over(Window.partitionBy(group)), F.lit(0.0))
    return scored.select(group, "label", "n", "accuracy", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support", F.round(macro, 6).alias("macro_f1"))


def breakdown_accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    hit = F.col("y_true") == F.col("y_pred")
    return pairs.groupBy(*by).agg(F.count_if(hit).alias("correct"), F.count("*").alias("total"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


# Accepted spellings of the sentiment labels.
SENTIMENT_ALIASES = {
    "positive": "positive", "pos": "positive", "مثبت": "positive",
    "negative": "negative", "neg": "negative", "منفی": "negative",
    "neutral": "neutral", "neu": "neutral", "خنثی": "neutral", "خنثي": "neutral",
    "mixed": "mixed", "آمیخته": "mixed",
    "unclear": "unclear", "نامشخص": "unclear",
}


def sentiment_alias(c: Column) -> Column:
    """The label that a spelling stands for, or null."""
    names = F.create_map(*[F.lit(x) for pair in SENTIMENT_ALIASES.items() for x in pair])
    return F.try_element_at(names, normalized(c))


def length_bucket(n: Column) -> Column:
    return F.when(n < 50, "short").when(n < 150, "medium").otherwise("long")


def kappa(pairs: DataFrame) -> DataFrame:
    """Of (axis, label_a, label_b): n, percent agreement and Cohen's kappa; complete agreement by chance is 1."""
    known = pairs.filter(is_present(F.col("label_a")) & is_present(F.col("label_b")))
    cells = known.groupBy("axis", "label_a", "label_b").agg(F.count("*").alias("c"))
    totals = cells.groupBy("axis").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("c")).otherwise(0)).alias("agree"))
    a = cells.groupBy("axis", F.col("label_a").alias("label")).agg(F.sum("c").alias("na"))
    b = cells.groupBy("axis", F.col("label_b").alias("label")).agg(F.sum("c").alias("nb"))
    chance = a.join(b, ["axis", "label"]).groupBy("axis").agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    j = totals.join(chance, "axis", "left")
    po, pe = F.col("agree") / F.col("n"), F.coalesce("products", F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select("axis", F.col("n").alias("n_compared"), F.round(po, 6).alias("percent_agreement"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))), 6).alias("cohens_kappa"))


def audit_metrics(audited: DataFrame, *by: str) -> DataFrame:
    """Of (eligible, human_relevance): inclusion precision and false exclusion rate; uncertain rows count apart."""
    decided, relevant = F.col("human_relevance").isin("relevant", "not_relevant"), (F.col("human_relevance") == "relevant").cast("double")
    return audited.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(decided & F.col("eligible")).alias("n_included_reviewed"), F.count_if(decided & ~F.col("eligible")).alias("n_excluded_reviewed"), F.count_if(F.col("human_relevance") == "uncertain").alias("n_uncertain"), F.round(F.avg(F.when(decided & F.col("eligible"), relevant)), 6).alias("inclusion_precision"), F.round(F.avg(F.when(decided & ~F.col("eligible"), relevant)), 6).alias("false_exclusion_rate"))


def route_scorecard(calls: DataFrame) -> DataFrame:
    """Per route: failures, parse failures, coverage, cost and latency per 1,000 records."""
    failed, unparsed = F.col("annotation_status") == "api_failure", F.col("annotation_status") == "json_parse_failure"
    return calls.groupBy("route").agg(F.count("*").alias("n_calls"), F.round(F.avg(failed.cast("double")), 6).alias("failure_rate"), F.round(F.avg(unparsed.cast("double")), 6).alias("parse_failure_rate"), F.round(F.avg((F.col("annotation_status") == "ok").cast("double")), 6).alias("coverage"), F.round(1000 * F.avg("cost_usd"), 6).alias("cost_per_1000"), F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"))


def cost_projection(calls: DataFrame, n_records: int, structural_tokens: float, price_per_million: float, least_calls: int = 3) -> DataFrame:
    """Cost and sequential hours of a full pass: a route's own average from three calls on, else all routes', else the structural estimate."""
    per = calls.groupBy("route").agg(F.count("tokens").alias("k"), F.avg("tokens").alias("own"), F.avg("latency_ms").alias("latency"))
    total = F.broadcast(calls.agg(F.avg("tokens").alias("shared"), F.avg("latency_ms").alias("shared_latency")))
    tokens = F.coalesce(F.when(F.col("k") >= least_calls, F.col("own")), F.col("shared"), F.lit(structural_tokens))
    latency = F.coalesce(F.when(F.col("k") >= least_calls, F.col("latency")), F.col("shared_latency"))
    return per.crossJoin(total).select("route", F.col("k").alias("n_calls"), F.when(F.col("k") >= least_calls, "own").when(F.col("shared").isNotNull(), "cross_route").otherwise("structural").alias("basis"), F.round(tokens * price_per_million / 1e6 * n_records, 4).alias("cost_usd"), F.round(latency * n_records / 3.6e6, 4).alias("sequential_hours"))


def unanimous_share(answers: DataFrame) -> DataFrame:
    """Share of contents on which all routes give one label, by axis."""
    per = answers.groupBy("axis", "content_id").agg(F.count_distinct("label").alias("k"))
    return per.groupBy("axis").agg(F.count("*").alias("n"), F.round(F.avg((F.col("k") == 1).cast("double")), 6).alias("unanimous_share"))
