"""Reconciliation of both page families of sessions in one job."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.operators import reconcile
from docketlake.operators.ledgers import PROOF
from docketlake.sources import html_tables

C = F.col
TESTIMONY, COMMITTEE = "publictestimonydocument", "committeemeetingdocument"
#: Findings about what pages show now, which a later read of the page settles.
SOURCE_ONLY, PAGE_ONLY, MISMATCH, OTHER_TYPE = "source_only", "page_only", "count_mismatch", "displayed_other_type"
#: Statuses of a session by priority, the first that any of its bills has.
PRIORITY = ["failed_fetch", "parser_anomalous", "checked_with_records", "checked_zero", "not_applicable"]


def display_status(statuses: DataFrame) -> DataFrame:
    """(session_key, display_status) of (session_key, status): the first by priority; not_applicable for a session without bills to check."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), C("status"))
    return statuses.groupBy("session_key").agg(F.min(F.when(rank > 0, F.struct(rank.alias("rank"), "status"))).alias("s")).select("session_key", F.coalesce("s.status", F.lit("not_applicable")).alias("display_status"))


def reconcile_families(bills: DataFrame, source: DataFrame, rendered: DataFrame, failures: DataFrame, reasons: DataFrame, reuse: DataFrame, ledger: DataFrame, now: Column) -> dict[str, DataFrame]:
    """records, checks, ledger and sessions after the pages of all candidate bills have been read against both families of source rows.

    bills: bill_id, session_key. source: bill_id, family, source_id, expected (whether a page should show it; all testimony is). rendered: (page_id, html), a page a bill. failures: bill_id of pages that
    could not be fetched. reasons: bill_id of candidates. reuse: (bill_id, status) of bills whose earlier checks still hold. ledger: (bill_id, family, anomaly_type, source_id, occurrences, resolved_at).

    checks (bill_id, family, status): not_applicable without a reason, the earlier status where it is reused, failed_fetch, else what the page gives; one page answers for both families. records (bill_id,
    family, source_id, origin, displayed, presence, reclassified): those of bills read now; a page that failed or is anomalous proves what it shows and no absence. A committee row that is shown though it is not
    expected is reclassified. ledger: open findings about display of bills that were read whole or are not applicable are resolved first, then what this read finds is merged: a recurring one is open again, its
    occurrences add up; a read that is no proof settles and finds nothing. sessions: display_status. Everything is joined by bill or record, for all bills at once.
    """
    todo = reasons.select("bill_id").distinct().join(reuse.select("bill_id"), "bill_id", "left_anti")
    failed = failures.select("bill_id").distinct().join(todo, "bill_id", "left_semi")
    parsed = html_tables.parse_pages(rendered.join(todo.join(failed, "bill_id", "left_anti").select(C("bill_id").alias("page_id")), "page_id", "left_semi"))
    checked = html_tables.identities_of(html_tables.check_pages(parsed), PROOF).persist(StorageLevel.DISK_ONLY)  # pages are parsed once for records, checks, ledger and sessions
    outcomes = html_tables.outcomes_of(checked).select(C("page_id").alias("bill_id"), C("outcome").alias("status"))
    read = outcomes.union(todo.join(outcomes, "bill_id", "left_anti").select("bill_id", F.lit("failed_fetch")))  # a page that is not there could not be fetched
    rest = bills.select("bill_id").join(reasons.select("bill_id").distinct(), "bill_id", "left_anti").select("bill_id", F.lit("not_applicable").alias("status"))
    earlier = reuse.join(reasons.select("bill_id").distinct(), "bill_id", "left_semi").select("bill_id", "status")
    statuses = read.union(rest).union(earlier)
    checks = statuses.withColumn("family", F.explode(F.array(F.lit(TESTIMONY), F.lit(COMMITTEE)))).select("bill_id", "family", "status")

    keys = ["bill_id", "family", "source_id"]
    answered = checked.select(C("page_id").alias("bill_id"), C("outcome").alias("status"))
    answered = answered.union(todo.join(answered, "bill_id", "left_anti").select("bill_id", F.lit("failed_fetch")))
    shown = checked.select(C("page_id").alias("bill_id"), C("outcome").alias("page_status"), F.explode("records").alias("r")).where("not r.conflict").select("bill_id", "r.family", "r.source_id", "page_status").where(C("family").isin(TESTIMONY, COMMITTEE)).distinct()
    ours = source.join(answered, "bill_id").groupBy(*keys, "status").agg(F.first("expected").alias("expected"))
    proves = F.coalesce("status", "page_status").isin(PROOF).alias("proves")
    # joined once for the records, the findings and the counts
    records = reconcile.two_sources(ours, shown, keys, C("status"), now, expected=C("expected"), keep=[C("expected"), proves]).drop("display_reconciled_at").persist(StorageLevel.DISK_ONLY)

    proof = read.where(C("status").isin(PROOF)).select("bill_id")
    proven = records.where("proves")
    odd = F.when((C("origin") == "source_only") & C("expected"), SOURCE_ONLY).when(C("origin") == "page_only", PAGE_ONLY).when(C("reclassified"), OTHER_TYPE)
    single = proven.select("bill_id", "family", odd.alias("anomaly_type"), "source_id").where("anomaly_type is not null")
    counts = proven.groupBy("bill_id", "family").agg(F.count_if((C("origin") != "page_only") & C("expected")).alias("n_source"), F.count_if("displayed").alias("n_page"))
    mismatch = counts.where("n_source <> n_page").select("bill_id", "family", F.lit(MISMATCH).alias("anomaly_type"), F.lit(None).cast("bigint").alias("source_id"))
    found = single.union(mismatch).withColumn("found_", F.lit(True))
    settled = proof.union(rest.select("bill_id")).distinct().withColumn("settled_", F.lit(True))
    display = C("anomaly_type").isin(SOURCE_ONLY, PAGE_ONLY, MISMATCH, OTHER_TYPE)
    stale = ledger.join(settled, "bill_id", "left").withColumn("resolved_at", F.coalesce("resolved_at", F.when(C("settled_") & display, now))).drop("settled_").withColumn("old_", F.lit(True))
    named = ["bill_id", "family", "anomaly_type", "source_id"]
    new = found.select(*[C(k).alias(f"n_{k}") for k in named], "found_")
    same = [C(k).eqNullSafe(C(f"n_{k}")) for k in named]
    merged = stale.join(new, same, "full_outer").select(
        *[F.when(C("old_"), C(k)).otherwise(C(f"n_{k}")).alias(k) for k in named],
        (F.coalesce("occurrences", F.lit(0)) + F.when(C("found_"), 1).otherwise(0)).cast("bigint").alias("occurrences"),
        F.when(C("found_"), None).otherwise(C("resolved_at")).alias("resolved_at"),
    )
    sessions = display_status(bills.join(statuses, "bill_id").select("session_key", "status"))
    return {"records": records.drop("expected", "proves"), "checks": checks, "ledger": merged, "sessions": sessions}
