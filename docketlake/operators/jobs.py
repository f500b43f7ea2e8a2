"""Whole jobs composed of the operators: an inventory load and the reconciliation of rendered pages."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.operators import merge, reconcile
from docketlake.operators.ledgers import PROOF
from docketlake.sources import html_tables, pages

C = F.col


def inventory_load(target: DataFrame, states: DataFrame, landed: DataFrame, key: str, session: str, prefixes: list[str], modified: str, now: Column, cursor: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, presence, violations) after a load of one session: scope, guard, keyed merge, presence.

    target: known rows. states: (key, presence, missing_since) of them. landed: what the source gave. Without a cursor the
    read is complete, so known rows of the session that it lacks become missing; with one it proves presence only.
    Rows outside the scope are never merged; they are counted by reason in violations, and a load with any is to be rejected.
    """
    fresh = pages.scoped_read(landed, session, prefixes, cursor, modified)[0].select(*target.columns)
    scope = target.where((C("session_key") == session) & C("measure_prefix").isin(prefixes)).select(key)
    known = states.join(scope, key, "left_semi")
    return merge.merge_keyed(target, fresh, [key]), merge.presence(known, fresh, key, cursor is None, now), pages.scope_violations(landed, session, prefixes)


def reconcile_pages(source: DataFrame, rendered: DataFrame, todo: DataFrame, reuse: DataFrame, ledger: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(records, ledger) after the pages of candidate bills have been read against the source.

    source: (bill_id, source_id). rendered: (page_id, html), a page a bill. todo: candidate bills; those in reuse keep
    their earlier checks. ledger: (bill_id, resolved_at, ...) of open findings; a page read whole resolves those of its bill.
    All joins are on the bill or on the record, for all bills at once.
    """
    bills = todo.select("bill_id").distinct().join(reuse.select("bill_id"), "bill_id", "left_anti")
    parsed = html_tables.parse_pages(rendered.join(bills.select(C("bill_id").alias("page_id")), "page_id", "left_semi"))
    checked = html_tables.identities_of(html_tables.check_pages(parsed), PROOF).persist(StorageLevel.DISK_ONLY)  # pages are parsed once for records, outcomes and ledger
    outcomes = checked.select(C("page_id").alias("bill_id"), "outcome")
    keys = ["bill_id", "source_id"]
    shown = html_tables.records_of(checked).where("not conflict").select(C("page_id").alias("bill_id"), "source_id")
    known = source.join(bills, "bill_id", "left_semi").join(outcomes, "bill_id", "left").select(*keys, "outcome").distinct()
    records = reconcile.two_sources(known, shown, keys, C("outcome"), now)
    read = outcomes.where(C("outcome").isin(PROOF))
    return records.select(F.concat_ws("-", *[C(k).cast("string") for k in keys]).alias("record"), *records.columns[len(keys):]), merge.resolve(ledger, read, "bill_id", now)


def inventory_run(target: DataFrame, states: DataFrame, landed: DataFrame, sync: DataFrame, failures: DataFrame, key: str, prefixes: list[str], modified: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, presence, sync) after a load of many sessions at once.

    sync: (session_key, entity, cursor, complete, last_error) of the sessions to load; those without a cursor are read in
    full, others from the cursor on. failures: (session_key, error) of reads that broke off: they merge nothing, prove
    no absence and leave the cursor where it is. states: (key, presence, missing_since).
    """
    failed = failures.select("session_key").distinct()
    plan = sync.select("session_key", "cursor").join(failed, "session_key", "left_anti")
    fresh = landed.where(C("measure_prefix").isin(prefixes)).join(plan, "session_key").where(C("cursor").isNull() | (C(modified) >= C("cursor")))
    known = target.where(C("measure_prefix").isin(prefixes)).join(plan, "session_key").select(key, "cursor").join(states, key)
    whole, part = C("cursor").isNull(), C("cursor").isNotNull()
    seen = merge.presence(known.where(whole).drop("cursor"), fresh.where(whole), key, True, now).unionByName(merge.presence(known.where(part).drop("cursor"), fresh.where(part), key, False, now))
    done = fresh.groupBy("session_key").agg(F.max(modified).alias("new_cursor"))
    outcome = plan.join(done, "session_key", "left").select("session_key", F.lit(True).alias("ok"), "new_cursor", F.lit(None).cast("string").alias("error"))
    broken = failures.groupBy("session_key").agg(F.lit(False).alias("ok"), F.max(F.lit(None).cast("timestamp")).alias("new_cursor"), F.min("error").alias("error"))
    entity = sync.select("session_key", "entity").distinct()
    return merge.merge_keyed(target, fresh.select(*target.columns), [key]), seen, merge.commit_cursor(sync, outcome.unionByName(broken).join(entity, "session_key"))
