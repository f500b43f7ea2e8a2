"""Searches of documents, runs, errors and anomalies with all their filters, and the feed of operations. An empty filter filters nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import contains_any

C = F.col


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _exact(**values: object) -> list[Column]:
    return [C(name) == value for name, value in values.items() if value not in (None, "")]


def _code(text: str) -> str:
    return text.replace(" ", "").strip().upper()


def bills_by_sponsor(bills: DataFrame, sponsors: DataFrame, name: str) -> DataFrame:
    """Bills with a sponsor (bill_id, sponsor_name) whose name contains the text."""
    return bills.join(sponsors.where(contains_any([C("sponsor_name")], name.strip())), "bill_id", "left_semi") if name.strip() else bills


def documents(docs: DataFrame, session: str = "", bill: str = "", kind: str = "", position: str = "", status: str = "", presence: str = "", committee: str = "", submitter: str = "", organization: str = "", displayed: str = "any", failed_only: bool = False) -> DataFrame:
    where = _exact(session_key=_code(session), bill_id_compact=_code(bill), document_kind=kind, testimony_position=position, download_status=status, source_presence=presence)
    where += [contains_any([C("committee_code"), C("committee_name")], committee.strip()), contains_any([C("submitter")], submitter.strip()), contains_any([C("city_organization"), C("on_behalf_of")], organization.strip())]
    if displayed != "any":
        where.append({"yes": C("displayed"), "no": ~C("displayed"), "unknown": C("displayed").isNull()}[displayed])
    if failed_only:
        where.append(C("download_status").isin("failed_retryable", "failed_terminal"))
    return docs.where(_all(where))


def runs(rows: DataFrame, run_type: str = "", status: str = "", scope: str = "") -> DataFrame:
    """Scope text is contained in the requested session, bill or scope, or is the run's id with or without #."""
    where = _exact(run_type=run_type, status=status)
    if scope.strip():
        asked = contains_any([C("requested_session_key"), C("requested_bill"), C("requested_scope_json")], scope.strip())
        where.append(asked | (C("run_id").cast("string") == scope.strip().lstrip("#")))
    return rows.where(_all(where))


def with_documents(ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of a ledger beside the kind and last HTTP status of their document (document_id), where they have one."""
    return ledger.join(docs.select("document_id", "document_kind", "http_status"), "document_id", "left")


def errors(rows: DataFrame, run: int | None = None, session: str = "", bill: str = "", stage_or_entity: str = "", kind: str = "", retryable: bool | None = None, error_class: str = "", unresolved_only: bool = True) -> DataFrame:
    """Errors beside their documents; error_class is contained in the class or in the HTTP status."""
    where = [C("resolved_at").isNull()] if unresolved_only else []
    where += _exact(run_id=run, session_key=_code(session), bill=_code(bill), document_kind=kind, retryable=retryable)
    where += [contains_any([C("stage"), C("source_entity_type")], stage_or_entity.strip()), contains_any([C("error_class"), C("http_status").cast("string")], error_class.strip())]
    return rows.where(_all(where))


def anomalies(rows: DataFrame, run: int | None = None, session: str = "", bill: str = "", stage_or_entity: str = "", kind: str = "", anomaly_type: str = "", severity: str = "", unresolved_only: bool = True) -> DataFrame:
    """Anomalies beside their documents; a run counts as the first or the last that saw them."""
    where = [C("resolved_at").isNull()] if unresolved_only else []
    where += _exact(session_key=_code(session), bill=_code(bill), document_kind=kind, severity=severity)
    where += [contains_any([C("source_entity_type")], stage_or_entity.strip()), contains_any([C("anomaly_type")], anomaly_type.strip())]
    if run is not None:
        where.append((C("first_run_id") == run) | (C("last_run_id") == run))
    return rows.where(_all(where))


#: Columns of the feed of operations.
FEED = "record_type id run_id session_key bill stage source_entity_type source_id document_kind error_class retryable anomaly_type severity message occurrence_count first_observed_at last_observed_at resolved_at source_url".split()


def operations(found_errors: DataFrame, found_anomalies: DataFrame, view: str = "all") -> DataFrame:
    """One feed of errors and anomalies (each already filtered), on one set of columns. Views: errors, anomalies, all."""
    left = found_errors.select(
        F.lit("error").alias("record_type"), "id", "run_id", "session_key", "bill", "stage", "source_entity_type", "source_id", "document_kind", "error_class",
        F.when(C("retryable"), "yes").otherwise("no").alias("retryable"), "message", C("attempt_count").alias("occurrence_count"),
        C("first_occurred_at").alias("first_observed_at"), C("last_occurred_at").alias("last_observed_at"), "resolved_at", "source_url",
    )
    right = found_anomalies.select(
        F.lit("anomaly").alias("record_type"), "id", C("last_run_id").alias("run_id"), "session_key", "bill", "source_entity_type", "source_id", "document_kind",
        "anomaly_type", "severity", "message", "occurrence_count", "first_observed_at", "last_observed_at", "resolved_at", "source_url",
    )
    if view not in ("all", "errors", "anomalies"):
        raise ValueError(f"unknown view {view!r}")
    both = left.unionByName(right, allowMissingColumns=True).select(*FEED)
    return both if view == "all" else both.where(C("record_type") == view[:-1] if view == "errors" else C("record_type") == "anomaly")


def newest_first() -> list[Column]:
    return [C("last_observed_at").desc_nulls_last(), C("id").desc(), C("record_type")]
