"""Merges of measures, references, anomalies, errors and states, and what resolves them. Each gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions import records as R
from docketlake.functions.text import blank, fingerprint
from docketlake.operators.merge import merge_keyed

C = F.col
#: Natural keys of the reference tables.
REFERENCE_KEYS = {
    "session": ["session_key"],
    "legislator": ["session_key", "legislator_code"],
    "committee": ["session_key", "committee_code"],
    "sponsor": ["bill_id", "source_measure_sponsor_id"],
    "meeting": ["session_key", "source_meeting_id"],
    "agenda": ["session_key", "source_agenda_item_id"],
}


def checked_bills(incoming: DataFrame) -> DataFrame:
    """incoming with problem: the first of identity, chamber, type that contradicts the prefix and number; null if none.

    A chamber, type or identity that is not given is taken from the prefix.
    """
    told = R.bill_parts(C("bill_id_compact"))
    own = R.bill_parts(F.concat("measure_prefix", C("measure_number").cast("string")))
    prefix = own["prefix"]
    problem = F.when(own.isNull() | (C("bill_id_compact").isNotNull() & ~told["compact"].eqNullSafe(own["compact"])), "identity")
    problem = problem.when(~F.coalesce(F.trim("bill_chamber"), R.prefix_chamber(prefix)).eqNullSafe(R.prefix_chamber(prefix)), "chamber")
    problem = problem.when(~F.coalesce(F.trim("measure_type"), R.prefix_meaning(prefix)).eqNullSafe(R.prefix_meaning(prefix)), "type")
    filled = {"bill_id_compact": own["compact"], "bill_chamber": R.prefix_chamber(prefix), "measure_type": R.prefix_meaning(prefix)}
    return incoming.withColumn("problem", problem).withColumns({c: F.when(C("problem").isNull(), v).otherwise(C(c)) for c, v in filled.items()})


def merge_bills(target: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bills, rejected, events) after measures of a source have been merged by session and bill.

    What was collected first stays; a measure that was missing is active again, with an event. Measures that
    contradict themselves are rejected and change nothing. incoming has one row a measure.
    """
    checked = checked_bills(incoming)
    keys = ["session_key", "bill_id_compact"]
    fresh = checked.where("problem is null").drop("problem").withColumns({"first_collected_at": now, "source_presence": F.lit("active"), "missing_since": F.lit(None).cast("timestamp")})
    events = target.where("source_presence = 'missing'").join(fresh, keys, "left_semi").select(*keys, F.lit("reappeared").alias("event"), now.alias("at"))
    return merge_keyed(target, fresh.select(*[c for c in target.columns if c in fresh.columns]), keys, preserve=["first_collected_at"]), checked.where("problem is not null"), events


def merge_reference(kind: str, target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a reference table: merged by its natural key; first_seen_at of known rows stays. Rows without a whole key are rejected."""
    keys = REFERENCE_KEYS[kind]
    whole = F.lit(True)
    for k in keys:
        whole = whole & ~blank(C(k).cast("string"))
    return merge_keyed(target, source.where(whole), keys, preserve=["first_seen_at"]), source.where(~whole)


def with_identity(seen: DataFrame, docs: DataFrame, bills: DataFrame) -> DataFrame:
    """Findings whose session and bill, where not given, are those of their document (document_id), else of their bill (bill_id)."""
    by_doc = docs.select("document_id", C("session_key").alias("d_session"), C("bill_id").alias("d_bill_id"), C("bill").alias("d_bill"))
    by_bill = bills.select(C("bill_id").alias("b_id"), C("session_key").alias("b_session"), C("bill").alias("b_bill"))
    found = seen.join(by_doc, "document_id", "left").withColumn("bill_id", F.coalesce("bill_id", "d_bill_id"))
    found = found.join(by_bill, C("bill_id") == C("b_id"), "left")
    found = found.withColumns({"session_key": F.upper(F.trim(F.coalesce("session_key", "d_session", "b_session"))), "bill": F.coalesce("bill", "d_bill", "b_bill")})
    return found.drop("d_session", "d_bill_id", "d_bill", "b_id", "b_session", "b_bill")


def anomaly_fingerprint() -> Column:
    return fingerprint([C(c) for c in ("anomaly_type", "session_key", "bill", "document_id", "source_entity_type", "source_id", "previous_value", "current_value")] + [F.substring("message", 1, 2000)])


def error_fingerprint(wide: bool = False) -> Column:
    """Of an error within its run: seven parts, or nine with the document and the address."""
    if wide:
        return fingerprint([C(c) for c in ("stage", "error_class", "message", "session_key", "bill", "source_entity_type", "source_id", "document_id", "source_url")])
    return fingerprint([C(c) for c in ("stage", "error_class", "session_key", "bill", "source_entity_type", "source_id")] + [F.substring("message", 1, 2000)], "|")


def merge_findings(ledger: DataFrame, seen: DataFrame, keys: list[str], latest: list[str], fixed: list[str]) -> DataFrame:
    """A ledger of findings after new ones (keys, at, run_id, ...): one row a key.

    First time and run stay, last ones move, occurrences add up, a finding that recurs is open again; `latest`
    columns are those of the newest occurrence, `fixed` ones those of the first. New rows are grouped
    before the join, with map-side combine, so a hot finding is one row a task.
    """
    fresh = seen.groupBy(*keys).agg(
        F.min("at").alias("n_first"), F.max("at").alias("n_last"), F.count("*").alias("n"),
        F.min_by("run_id", F.struct("at", "run_id")).alias("n_first_run"), F.max_by("run_id", F.struct("at", "run_id")).alias("n_last_run"),
        *[F.max_by(c, F.struct("at", "run_id", c)).alias(f"n_{c}") for c in latest], *[F.min_by(c, F.struct("at", "run_id", c)).alias(f"n_{c}") for c in fixed],
    )
    both = ledger.join(fresh, keys, "full_outer")
    new = C("n").isNotNull()
    return both.select(
        *keys,
        F.least("first_observed_at", "n_first").alias("first_observed_at"),
        F.greatest("last_observed_at", "n_last").alias("last_observed_at"),
        F.coalesce("first_run_id", "n_first_run").alias("first_run_id"),
        F.coalesce("n_last_run", "last_run_id").alias("last_run_id"),
        (F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrence_count"),
        F.when(~new, C("resolved_at")).alias("resolved_at"),
        *[F.when(new, C(f"n_{c}")).otherwise(C(c)).alias(c) for c in latest],
        *[F.coalesce(c, f"n_{c}").alias(c) for c in fixed],
    )


def resolve_anomalies(ledger: DataFrame, now: Column, ids: DataFrame | None = None, bills: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Open anomalies become resolved: by id; by bill and type; by session and type, which takes those without a bill only.

    ids: id. bills: bill, anomaly_type. sessions: session_key, anomaly_type.
    """
    for frame, keys, only in ((ids, ["id"], F.lit(True)), (bills, ["bill", "anomaly_type"], F.lit(True)), (sessions, ["session_key", "anomaly_type"], C("bill").isNull())):
        if frame is not None:
            hit = frame.select(*keys).distinct().withColumn("hit_", F.lit(True))
            ledger = ledger.join(hit, keys, "left").withColumn("resolved_at", F.coalesce("resolved_at", F.when(C("hit_") & only, now))).drop("hit_")
    return ledger


def resolve_errors(ledger: DataFrame, entities: DataFrame, bills: DataFrame, now: Column) -> DataFrame:
    """Open errors become resolved by the exact entity they name (source_entity_type, source_id), or, where they name none, by their bill."""
    named = C("source_id").isNotNull()
    by_entity = entities.select("source_entity_type", "source_id").distinct().withColumn("e_", F.lit(True))
    by_bill = bills.select("bill").distinct().withColumn("b_", F.lit(True))
    found = ledger.join(by_entity, ["source_entity_type", "source_id"], "left").join(by_bill, "bill", "left")
    hit = F.when(named, C("e_")).otherwise(C("b_"))
    return found.withColumn("resolved_at", F.coalesce("resolved_at", F.when(hit, now))).drop("e_", "b_")


#: Results of a page check that prove what a page shows.
PROOF = ["checked_with_records", "checked_zero"]


def merge_checks(state: DataFrame, checks: DataFrame) -> DataFrame:
    """Latest check of each (bill_id, family): status and checked_at move; counts move with checks that succeeded only."""
    new = checks.groupBy("bill_id", "family").agg(F.max("checked_at").alias("n_at"), F.max_by("status", F.struct("checked_at", "status")).alias("n_status"), F.max_by("displayed_count", F.when(C("status").isin(PROOF), F.struct("checked_at", "displayed_count"))).alias("n_count"))
    both = state.join(new, ["bill_id", "family"], "full_outer")
    newer = C("n_at").isNotNull() & (C("checked_at").isNull() | (C("n_at") >= C("checked_at")))
    return both.select("bill_id", "family", F.when(newer, C("n_status")).otherwise(C("status")).alias("status"), F.when(newer, C("n_at")).otherwise(C("checked_at")).alias("checked_at"), F.when(newer, F.coalesce("n_count", "displayed_count")).otherwise(C("displayed_count")).alias("displayed_count"))


def displayed_after(docs: DataFrame, checks: DataFrame, shown: DataFrame) -> DataFrame:
    """Documents with displayed as their bill's check of their family leaves it: only a check that succeeded writes true or false."""
    fine = checks.where(C("status").isin(PROOF)).select("bill_id", "family").distinct().withColumn("fine_", F.lit(True))
    here = shown.select("doc_key").distinct().withColumn("shown_", F.lit(True))
    return docs.join(fine, ["bill_id", "family"], "left").join(here, "doc_key", "left").withColumn("displayed", F.when(C("fine_"), C("shown_").isNotNull()).otherwise(C("displayed"))).drop("fine_", "shown_")


def merge_probes(known: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Latest probe of each document; of equal times the larger size. A probe older than the known one changes nothing."""
    new = probes.groupBy(key).agg(F.max("probed_at").alias("n_at"), F.max_by("size", F.struct("probed_at", "size")).alias("n_size"))
    both = known.join(new, key, "full_outer")
    newer = C("n_at").isNotNull() & (C("probed_at").isNull() | (C("n_at") >= C("probed_at")))
    return both.select(key, F.when(newer, C("n_at")).otherwise(C("probed_at")).alias("probed_at"), F.when(newer, C("n_size")).otherwise(C("size")).alias("size"))


def merge_session_state(state: DataFrame, activity: DataFrame) -> DataFrame:
    """Archive state of sessions after activity (session_key, event, run_id, at, outcome): started, finished, stopped, download.

    The newest of started, finished and stopped decides the status; the last success stays until another one; downloads move their own time.
    """
    inventory = C("event").isin("started", "finished", "stopped")
    order = F.struct("at", "run_id")
    fine = (C("event") == "finished") & C("outcome").isin("inventory_complete", "inventory_complete_with_errors")
    new = activity.groupBy("session_key").agg(
        F.max_by(F.struct("event", "outcome", "run_id"), F.when(inventory, order)).alias("last"),
        F.max(F.when(C("event") == "started", C("at"))).alias("n_started"),
        F.max(F.when(C("event") == "finished", C("at"))).alias("n_finished"),
        F.max_by("run_id", F.when(fine, order)).alias("n_success"),
        F.max(F.when(C("event") == "download", C("at"))).alias("n_download"),
    )
    status = F.when(C("last.event") == "started", "inventory_running").when(C("last.event") == "stopped", "interrupted").otherwise(C("last.outcome"))
    both = state.join(new, "session_key", "full_outer")
    return both.select(
        "session_key",
        F.coalesce(status, "inventory_status", F.lit("not_started")).alias("inventory_status"),
        F.coalesce("n_started", "last_started_at").alias("last_started_at"),
        F.coalesce("n_finished", "last_completed_at").alias("last_completed_at"),
        F.coalesce("last.run_id", "last_run_id").alias("last_run_id"),
        F.coalesce("n_success", "last_successful_run_id").alias("last_successful_run_id"),
        F.coalesce("n_download", "last_download_at").alias("last_download_at"),
    )


def invalidate_scope(sync: DataFrame, sessions: DataFrame, covered: list[str], wanted: list[str], entities: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sync, sessions) once the measure prefixes to be covered widen: cursors and completeness of what depends on measures start
    again, history (ids of runs, counts of other entities) stays. Where nothing new is wanted, nothing changes."""
    if set(wanted) <= set(covered):
        return sync, sessions
    hit = C("entity").isin(entities)
    reset = {c: F.when(~hit, C(c)) for c in ("cursor", "last_full_at", "last_successful_run_id")}
    sync = sync.withColumns(reset | {"outcome": F.when(hit, "invalidated_expanded_measure_scope").otherwise(C("outcome")), "complete": ~hit & C("complete")})
    return sync, sessions.withColumns({"inventory_status": F.lit("not_started"), "last_completed_at": F.lit(None).cast("timestamp"), "last_successful_run_id": F.lit(None).cast("bigint")})


def rekey_families(results: DataFrame, testimony_bills: DataFrame) -> DataFrame:
    """Results of page checks under the family they are about: those not applicable and those of bills with testimony are testimony."""
    said = testimony_bills.select("bill_id").distinct().withColumn("said_", F.lit(True))
    return results.join(said, "bill_id", "left").withColumn("family", F.when((C("status") == "not_applicable") | C("said_"), "testimony").otherwise("committee_documents")).drop("said_")


def type_drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, drift, old, new): documents whose type as the source writes it, or as it is classified, has changed; text compares without case and outer space."""
    new = after.select(key, C("raw_type").alias("n_raw"), C("kind").alias("n_kind"))
    both = before.select(key, "raw_type", "kind").join(new, key)
    same = lambda a, b: F.lower(F.trim(F.coalesce(a, F.lit("")))).eqNullSafe(F.lower(F.trim(F.coalesce(b, F.lit("")))))
    cells = F.array(F.when(~same("raw_type", "n_raw"), F.struct(F.lit("raw_type").alias("drift"), C("raw_type").alias("old"), C("n_raw").alias("new"))), F.when(~C("kind").eqNullSafe(C("n_kind")), F.struct(F.lit("kind").alias("drift"), C("kind").alias("old"), C("n_kind").alias("new"))))
    return both.select(key, F.explode(F.array_compact(cells)).alias("x")).select(key, "x.drift", "x.old", "x.new")
