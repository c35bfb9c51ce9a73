"""The eligibility funnel: every record gets one of six targets and a reason, none is dropped.

All stages are one priority chain of conditions over the row, so the only
shuffle is the exact-id deduplication window. The order of the stages is the
order of the chain: raw validation, duplicates, dates, text, provenance,
topic, role.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.calendar import OUT, PROJECT, ProjectCalendar
from weirflow.functions.text import is_empty_text, is_present, is_synthetic, is_url_only, normalized, split_ids

TARGETS = ("opinion_main", "opinion_limited", "opinion_untimed", "context_only", "audit_only", "quarantine")
VALID_PLATFORMS = ("x", "reddit", "youtube")
# The content types that are known.
CONTENT_TYPES = ("original_post", "comment", "reply", "quote", "repost", "video_context", "deleted_or_unavailable", "unknown")
#: Kinds that need no text of their own, on any platform.
TEXTLESS = ("video_context", "repost")


def _first(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that holds."""
    out = default
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def keep_earliest(records: DataFrame) -> DataFrame:
    """Adds is_duplicate_id and the merged query ids: within platform and id the earliest collected row stays.

    A row without any id is a key of its own, so such rows do not meet in one task. Query ids
    are merged by an aggregation beside the window, on the same key and so the same shuffle.
    """
    has_id, has_uid = is_present(F.col("platform_content_id")), is_present(F.col("record_uid"))
    none = F.concat(F.lit("none::"), F.xxhash64("platform", "collected_at", "original_row_number", "matched_query_ids").cast("string"))
    key = F.when(has_id, F.concat(F.lower("platform"), F.lit("::"), "platform_content_id")).when(has_uid, F.concat(F.lit("uid::"), "record_uid")).otherwise(none)
    keyed = records.withColumn("__key", F.coalesce(key, none))
    order = Window.partitionBy("__key").orderBy(F.asc_nulls_last("collected_at"), F.asc_nulls_last("original_row_number"), F.asc_nulls_last("record_uid"))
    ids = keyed.select("__key", F.explode(split_ids(F.col("matched_query_ids"))).alias("q")).groupBy("__key").agg(F.array_join(F.array_sort(F.collect_set("q")), ";").alias("__ids"))
    numbered = keyed.withColumn("is_duplicate_id", F.row_number().over(order) > 1).join(ids, "__key", "left")
    merged = F.when(F.col("is_duplicate_id"), F.col("matched_query_ids")).otherwise(F.coalesce("__ids", F.lit("")))
    return numbered.withColumn("merged_query_ids", merged).drop("__key", "__ids")


def decide(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """``records`` with dataset_target, stage, reason, secondary_reasons, provenance_quality and project_week.

    Needs: platform, platform_content_id, record_uid, created_at, collected_at,
    original_row_number, matched_query_ids, timestamp_origin, content_type,
    content_status, text_raw, provenance_quality, collection_run_id,
    original_file_name, query_id, source_id; original_file_sha256 where there is one.
    """
    c = F.col
    platform, kind, status = normalized(c("platform")), normalized(c("content_type")), F.coalesce(normalized(c("content_status")), F.lit(""))
    has_id, has_uid = is_present(c("platform_content_id")), is_present(c("record_uid"))
    untimed = c("created_at").isNull() | F.coalesce(normalized(c("timestamp_origin")) == "unknown", F.lit(False))
    week = calendar.week(c("created_at"))
    empty = is_empty_text(c("text_raw"))
    op_empty = (platform == "reddit") & (kind == "original_post") & empty
    textless = kind.isin(*TEXTLESS) | op_empty
    upstream = F.when(is_present(c("provenance_quality")), normalized(c("provenance_quality"))).otherwise("")
    has_run, has_file = is_present(c("collection_run_id")), is_present(c("original_file_name"))
    if "original_file_sha256" in records.columns:
        has_file = has_file | is_present(c("original_file_sha256"))
    linked = has_run & is_present(c("query_id")) & is_present(c("source_id"))
    not_auditable = ~has_run & ~has_file & ~upstream.isin("complete", "partial", "reconstructed")
    quality = _first([(upstream == "complete", F.lit("complete")), (upstream.isin("partial", "reconstructed"), F.lit("partial")), (not_auditable, F.lit("unknown")), (linked, F.lit("complete"))], F.lit("partial"))
    no_query = ~is_present(c("query_id")) & ~is_present(c("matched_query_ids"))

    def out(stage: str, target: str, reason: str | None) -> Column:
        return F.struct(F.lit(target).alias("dataset_target"), F.lit(stage).alias("stage"), F.lit(reason).cast("string").alias("reason"))

    known = F.coalesce(kind.isin(*CONTENT_TYPES), F.lit(False))
    rules = [
        (~F.coalesce(platform.isin(*VALID_PLATFORMS), F.lit(False)), out("raw_validation", "quarantine", "other_documented")),
        (~has_id & ~has_uid, out("raw_validation", "quarantine", "missing_content_id")),
        (c("is_duplicate_id"), out("dedup", "quarantine", "duplicate_exact_id")),
        (~untimed & (week == OUT), out("date_rule", "quarantine", "out_of_window")),
        (F.coalesce(kind == "deleted_or_unavailable", F.lit(False)) | status.isin("deleted", "removed"), out("text", "audit_only", "deleted_or_removed")),
        (~known, out("text", "quarantine", "invalid_content_type")),
        (~textless & empty, out("text", "quarantine", "empty_text")),
        (not_auditable, out("provenance", "quarantine", "invalid_provenance")),
        (is_synthetic(c("text_raw")), out("topic", "quarantine", "synthetic_or_test")),
        (no_query & is_url_only(c("text_raw")), out("topic", "quarantine", "out_of_scope")),
        (kind == "video_context", out("role", "context_only", None)),
        (kind == "repost", out("role", "audit_only", "repost_only")),
        (op_empty, out("role", "context_only", None)),
        (untimed, out("role", "opinion_untimed", None)),
        (quality == "partial", out("role", "opinion_limited", None)),
    ]
    decided = keep_earliest(records).withColumn("__d", _first(rules, out("role", "opinion_main", None)))
    flags = F.concat_ws(";", F.when(~has_id & has_uid, "surrogate_id_only"), F.when(quality == "partial", "limited_provenance"), F.when(untimed, "missing_timestamp"))
    secondary = F.when(c("__d.stage").eqNullSafe("role") & c("__d.dataset_target").startswith("opinion") & (flags != ""), flags)
    return decided.withColumns({"dataset_target": c("__d.dataset_target"), "stage": c("__d.stage"), "reason": c("__d.reason"), "secondary_reasons": secondary, "provenance_assessed": quality, "project_week": week}).drop("__d")


def audit_trail(decided: DataFrame) -> DataFrame:
    """The decision columns of every record."""
    names = ["record_uid", "platform", "platform_content_id", "dataset_target", "stage", "reason", "secondary_reasons", "provenance_assessed", "project_week", "merged_query_ids"]
    return decided.select(*names)


def reconciliation(decided: DataFrame) -> DataFrame:
    """Rows by target, platform and reason."""
    return decided.groupBy("dataset_target", "platform", "reason").agg(F.count("*").alias("n"))


def check_reconciled(n_input: int, decided: DataFrame) -> None:
    """Fails unless the targets add up to the input."""
    found = decided.agg(F.count("*"), F.count_if(F.col("dataset_target").isin(*TARGETS))).first()
    if not n_input == found[0] == found[1]:
        raise ValueError(f"{n_input} rows came in, {found[0]} were decided, {found[1]} of them with a known target")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
