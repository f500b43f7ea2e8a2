"""Two-source reconciliation, candidates and reusable checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def two_sources(source: DataFrame, page: DataFrame, key: str | list[str], outcome: Column, now: Column, expected: Column | None = None, keep: Sequence[Column] = ()) -> DataFrame:
    """(key, origin, displayed, presence, display_reconciled_at, reclassified) of records in a source and on pages.

    outcome: the page read's result; only a complete one (checked_with_records or checked_zero) proves
    that a record is not displayed, and displayed stays null otherwise. expected: which source records the
    page should show; one shown against it is reclassified. The key, one column or several, is joined whole, so a bill with very many records is spread.
    page: the key, and what else `keep` names; a row a key unless only the key is given. keep: further columns, over those of both sides.
    """
    keys = [key] if isinstance(key, str) else key
    left = source.withColumn("in_source", F.lit(True)).withColumn("expected", F.lit(True) if expected is None else expected)
    shown = page if keep else page.select(*keys).distinct()
    both = left.join(shown.withColumn("on_page", F.lit(True)), keys, "full_outer")
    s, p = C("in_source").isNotNull(), C("on_page").isNotNull()
    displayed = F.when(p, True).when(outcome.isin("checked_with_records", "checked_zero"), False)
    return both.select(
        *keys,
        F.when(s & p, "both").when(s, "source_only").otherwise("page_only").alias("origin"),
        displayed.alias("displayed"),
        F.when(s, "active").otherwise("unknown").alias("presence"),
        F.when(displayed.isNotNull(), now).alias("display_reconciled_at"),
        F.coalesce(s & p & ~C("expected"), F.lit(False)).alias("reclassified"),
        *keep,
    )


def candidates(bills: DataFrame, testimony: DataFrame, committee: DataFrame, agenda: DataFrame) -> DataFrame:
    """(bill_id, reasons): why a bill's page is worth reading, in fixed order; bills without a reason are left out.

    testimony: bill_id. committee: bill_id, row_id, kind (the first presentation-capable or unknown row gives
    its reason). agenda: bill_id, meeting_type (collapsed and folded equal to "public hearing").
    """
    shown = committee.where(C("kind").isin("committee_presentation", "legacy_testimony", "unknown"))
    first = shown.groupBy("bill_id").agg(F.min_by(F.when(C("kind") == "unknown", "unknown_committee_document").otherwise("committee_presentation"), "row_id").alias("committee_reason"))
    hearing = agenda.where(F.lower(F.trim(F.regexp_replace("meeting_type", r"\s+", " "))) == "public hearing").select("bill_id").distinct().withColumn("hearing", F.lit("public_hearing_agenda"))
    said = testimony.select("bill_id").distinct().withColumn("testimony", F.lit("public_testimony"))
    joined = bills.select("bill_id").join(said, "bill_id", "left").join(first, "bill_id", "left").join(hearing, "bill_id", "left")
    return joined.select("bill_id", F.array_compact(F.array("testimony", "committee_reason", "hearing")).alias("reasons")).where(F.size("reasons") > 0)


def reusable(checks: DataFrame, inputs: DataFrame) -> DataFrame:
    """bill_ids whose checks of both families succeeded and none of whose inputs (bill_id, changed_at) is newer than the older check."""
    fine = checks.groupBy("bill_id").agg(F.min("checked_at").alias("checked_at"), F.countDistinct("family").alias("families"), F.bool_and(C("status").isin("checked_with_records", "checked_zero", "not_applicable")).alias("fine"))
    newest = inputs.groupBy("bill_id").agg(F.max("changed_at").alias("changed_at"))
    return fine.where("fine and families = 2").join(newest, "bill_id", "left").where("changed_at is null or changed_at <= checked_at").select("bill_id")


def scope_exit(in_scope: Column, presence: Column, first_seen: Column, cutoff: Column, kind_selected: Column, url_blank: Column, resumable: Column) -> Column:
    """First reason for which a queued document leaves a frozen scope; null if it stays."""
    return F.when(~in_scope, "session_outside_scope").when(presence != "active", "presence_outside_scope").when(first_seen > cutoff, "first_seen_after_cutoff").when(~kind_selected, "kind_not_selected").when(url_blank, "blank_url").when(~resumable, "status_not_resumable")


def payload_state(status: Column, source_changed: Column, file_valid: Column, url_blank: Column) -> Column:
    """What an audit makes of a downloaded document."""
    return F.when(file_valid & ~source_changed, "valid").when(url_blank, "failed_terminal").when(source_changed, "changed_remote").otherwise("missing_local")
