"""Predicates of the searches. A filter whose value is empty filters nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import blank, contains, contains_any

#: Status sets of downloads.
RETRYABLE = ["discovered", "queued", "failed_retryable", "paused_low_space", "interrupted", "missing_local", "changed_remote"]
MATCHING_RETRY = ["failed_retryable", "failed_terminal", "interrupted", "missing_local", "paused_low_space"]
PAYLOAD_KINDS = ["public_testimony", "legacy_testimony", "committee_presentation", "floor_letter"]


def enacted(flag: Column, chapter: Column, wanted: bool | None) -> Column:
    """Tri-state: the flag or a chapter number proves enactment; both must deny it for false; None asks nothing."""
    if wanted is None:
        return F.lit(True)
    proven = F.coalesce(flag, F.lit(False)) | ~blank(chapter)
    return proven if wanted else ~proven


def bill_search(bills: DataFrame, session: str = "", chamber: str = "", text: str = "", enacted_only: bool | None = None) -> DataFrame:
    session = session.strip().upper()
    where = contains_any([F.col(c) for c in ("bill_title", "measure_number", "measure_prefix", "chapter_number")], text)
    where = where & enacted(F.lit(None).cast("boolean"), F.col("chapter_number"), enacted_only)
    if session:
        where = where & (F.col("session_key") == session)
    if chamber:
        where = where & (F.col("bill_chamber") == chamber)
    return bills.where(where)


def document_search(docs: DataFrame, kind: str = "", status: str = "", url: str = "", displayed: str = "any", failed_only: bool = False) -> DataFrame:
    where = F.lit(True)
    if kind:
        where = where & (F.col("document_kind") == kind)
    if status:
        where = where & (F.col("download_status") == status)
    if url:
        where = where & contains(F.col("canonical_download_url"), url)
    if displayed != "any":
        where = where & {"yes": F.col("displayed"), "no": ~F.col("displayed"), "unknown": F.col("displayed").isNull()}[displayed]
    if failed_only:
        where = where & F.col("download_status").isin("failed_retryable", "failed_terminal")
    return docs.where(where)


def run_search(items: DataFrame, status: str = "", scope: str = "") -> DataFrame:
    """Scope text is contained in the item key, or is the run's id with or without #."""
    where = F.lit(True)
    if status:
        where = where & (F.col("status") == status)
    if scope:
        where = where & (contains(F.col("item_key").cast("string"), scope) | (F.col("run_id").cast("string") == scope.lstrip("#")))
    return items.where(where)


def open_rows(ledger: DataFrame) -> DataFrame:
    return ledger.where("resolved_at is null")


def ledger_search(ledger: DataFrame, message: str = "", run: int | None = None) -> DataFrame:
    where = contains_any([F.col("message")], message)
    return ledger.where(where if run is None else where & (F.col("run_id") == run))


def retry_eligible(docs: DataFrame, bills: DataFrame, first_year: int, include_terminal: bool) -> DataFrame:
    """Documents of supported years with a URL, a payload kind and a status that a retry may take up."""
    statuses = [s for s in MATCHING_RETRY if include_terminal or s != "failed_terminal"]
    fit = docs.where(F.col("download_status").isin(statuses) & F.col("document_kind").isin(PAYLOAD_KINDS) & ~blank(F.col("canonical_download_url")))
    return fit.join(bills.where(F.substring("session_key", 1, 4).try_cast("int") >= first_year).select("bill_id", "session_key"), "bill_id")


def download_candidates(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("document_kind").isin(PAYLOAD_KINDS) & (F.col("download_status") != "not_applicable") & ~blank(F.col("canonical_download_url")))


def valid_completed(recorded: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds valid: the recorded path, name and size are those of a listed file (path, length)."""
    found = recorded.join(listing.select(F.col("path").alias("listed"), "length"), F.col("local_path") == F.col("listed"), "left")
    named = F.element_at(F.split("local_path", "/"), -1) == F.col("file_name")
    return found.withColumn("valid", F.coalesce((F.col("validation_status") == "valid") & named & (F.col("length") == F.col("downloaded_bytes")), F.lit(False))).drop("listed", "length")


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """Rows of one whole key. The conditions reach the scan, so row groups of other keys are not read."""
    where = F.lit(True)
    for name, value in keys.items():
        where = where & (F.col(name) == value)
    return rows.where(where)
