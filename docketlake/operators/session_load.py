"""Load of whole sessions with all their entities, in order of dependency, published at once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.text import fingerprint
from docketlake.operators import merge, rollups, tracked
from docketlake.streaming.loads import _files, _names

C = F.col


@dataclass(frozen=True)
class Entity:
    """An entity set: its key besides the session, whether its rows carry a measure prefix, whether they are dated, and the parent
    whose column each of its columns must be found in."""

    name: str
    key: str
    scoped: bool = True
    dated: bool = True
    parents: tuple[tuple[str, str, str], ...] = ()  # (entity, its column, own column)
    tracked: bool = False


_BILL = (("Measures", "bill", "bill"),)
#: Entity sets in the order of their dependency. Floor letters have no dates, so they are read in full each time.
ENTITIES = (
    Entity("Legislators", "legislator_code", scoped=False),
    Entity("Committees", "committee_code", scoped=False),
    Entity("Measures", "bill", tracked=True),
    Entity("MeasureSponsors", "sponsor_id", parents=_BILL),
    Entity("CommitteeMeetings", "meeting_id", scoped=False, parents=(("Committees", "committee_code", "committee_code"),)),
    Entity("CommitteeAgendaItems", "agenda_id", parents=(*_BILL, ("CommitteeMeetings", "meeting_id", "meeting_id"))),
    Entity("CommitteeMeetingDocuments", "source_id", parents=_BILL, tracked=True),
    Entity("CommitteePublicTestimonies", "source_id", parents=_BILL, tracked=True),
    Entity("FloorLetters", "source_id", dated=False, parents=_BILL, tracked=True),
)


def read_for(landed: DataFrame, plan: DataFrame, entity: Entity) -> DataFrame:
    """What was landed for the sessions of a plan (session_key, cursor): all of it where there is no cursor, else from the cursor on, inclusive.

    landed has `asked`, the session that a row was delivered for.
    """
    rows = landed.join(plan.select(C("session_key").alias("asked"), "cursor"), "asked")
    return rows.where(C("cursor").isNull() | (C("modified_at") >= C("cursor"))) if entity.dated else rows


def load_problems(rows: DataFrame, entity: Entity, prefixes: list[str], parents: dict[str, DataFrame]) -> DataFrame:
    """(session_key, error): sessions whose read holds rows outside the session or its prefixes, or rows without a parent among the merged ones."""
    outside = ~C("session_key").eqNullSafe(C("asked"))
    if entity.scoped:
        outside = outside | ~F.coalesce(C("measure_prefix").isin(prefixes), F.lit(False))
    found = rows.where(outside).groupBy("asked").agg(F.count("*").alias("n")).select(C("asked").alias("session_key"), F.format_string("%d rows outside the scope", "n").alias("error"))
    for name, theirs, own in entity.parents:
        known = parents[name].select(C("session_key").alias("p_session"), C(theirs).alias("p_key"))
        lost = rows.where(C(own).isNotNull() & ~outside).join(known, (C("asked") == C("p_session")) & (C(own) == C("p_key")), "left_anti")
        found = found.union(lost.groupBy("asked").agg(F.count("*").alias("n")).select("asked", F.format_string(f"%d rows without their {name}", "n")))
    return found


def load_sessions(spark: SparkSession, root: str, targets: dict[str, DataFrame], landed: dict[str, DataFrame], sync: DataFrame, failures: DataFrame, ledger: DataFrame, probes: DataFrame, prefixes: list[str], now: Column, run_id: int) -> bool:
    """Load the sessions of a run, all at once and entity by entity, and publish all tables by one pointer; False if the run was published before.

    sync: (session_key, entity, cursor, complete, last_error), a row for each session and entity to load; without a cursor a read is complete.
    failures: (session_key, entity, error) of reads that broke off. ledger: (fingerprint, session_key, affects_completeness, first_seen, last_seen, occurrences, resolved_at,
    message) of known anomalies. probes: (session_key, failed). targets and landed: by entity; landed rows have `asked`, their key, and `modified_at` where dated.

    A session ends at its first entity that fails: the read broke off, holds rows outside the scope, or rows whose parent is not there. That entity
    and the later ones merge nothing, and the failed one keeps its cursor; what came before stays loaded. Measures and documents that a complete read lacks become missing.
    Tables: each entity; `events` (changes of presence), `anomalies` (the ledger with what the merge has found), `errors`,
    `sync`, and `sessions` with the completeness of each session of the run. Sets of sessions are joined, never looped over; each table is written once, so a lost executor costs a task.
    """
    if run_id in _runs(spark, root):
        return False
    folder = f"{root}/data/{run_id}-{uuid.uuid4().hex}"

    def stored(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    # what the run asks for is a row a session and entity: written once, its size is known and it is sent to the rows, not these to it
    sync, failures = stored("asked-sync", sync), stored("asked-failures", failures)
    sessions = sync.select("session_key").distinct()
    stopped, merged, findings, synced = None, {}, None, None
    for entity in ENTITIES:
        plan = sync.where(C("entity") == entity.name).select("session_key", "cursor")
        if stopped is not None:
            plan = plan.join(stopped.select("session_key"), "session_key", "left_anti")
        fresh = stored(f"read-{entity.name}", read_for(landed[entity.name], plan, entity))  # a source is read once for its checks, its merge and its cursors
        told = failures.where(C("entity") == entity.name).join(plan.select("session_key"), "session_key", "left_semi").select("session_key", "error")
        bad = told.union(load_problems(fresh.join(told.select(C("session_key").alias("asked")), "asked", "left_anti"), entity, prefixes, merged))
        bad = stored(f"bad-{entity.name}", bad.groupBy("session_key").agg(F.min("error").alias("error")).select("session_key", F.lit(entity.name).alias("entity"), "error"))
        fine = plan.join(bad, "session_key", "left_anti")
        rows = fresh.join(bad.select(C("session_key").alias("asked")), "asked", "left_anti")
        keys = ["session_key", entity.key]
        target = targets[entity.name]
        if entity.tracked:
            whole = fine.where("cursor is null") if entity.dated else fine
            both = stored(f"merge-{entity.name}", tracked.merge_tracked(target, rows.drop("asked", "cursor"), keys, now, whole, C("measure_prefix").isin(prefixes)))
            found = tracked.findings_of(both, keys).select("session_key", F.lit(entity.name).alias("entity"), C(entity.key).cast("string").alias("id"), "finding", "previous", "current")
            findings = found if findings is None else findings.union(found)
            merged[entity.name] = both.drop("findings")
        else:
            incoming = rows.withColumns({"first_seen_at": now, "last_seen_at": now}).select(*[c for c in target.columns if c in rows.columns or c in ("first_seen_at", "last_seen_at")])
            merged[entity.name] = stored(entity.name, merge.merge_keyed(target, incoming, keys, preserve=["first_seen_at"]))
        latest = rows.groupBy(C("asked").alias("session_key")).agg(F.max("modified_at").alias("new_cursor")) if entity.dated else rows.select(C("asked").alias("session_key"), F.lit(None).cast("timestamp").alias("new_cursor")).limit(0)
        done = fine.join(latest, "session_key", "left").select("session_key", F.lit(entity.name).alias("entity"), F.lit(True).alias("ok"), "new_cursor", F.lit(None).cast("string").alias("error"))
        outcome = stored(f"outcome-{entity.name}", done.union(bad.select("session_key", "entity", F.lit(False), F.lit(None).cast("timestamp"), "error")))
        synced = outcome if synced is None else synced.union(outcome)
        stopped = bad if stopped is None else stopped.union(bad)
    stored("sync", merge.commit_cursor(sync, synced))
    stored("errors", stopped)
    stored("events", findings.where(C("finding") == tracked.PRESENCE).drop("finding"))
    seen = findings.where(C("finding") != tracked.PRESENCE)
    print_ = fingerprint([C(c) for c in ("finding", "session_key", "entity", "id", "previous", "current")]).alias("fingerprint")
    seen = stored("seen", seen.select(print_, "session_key", "finding", "entity", "id"))
    about = seen.groupBy("fingerprint").agg(F.min("session_key").alias("session_key"))
    known = merge.ledger_merge(ledger.drop("session_key", "affects_completeness"), seen.select("fingerprint", now.alias("at"), F.concat_ws(" ", "finding", "entity", "id").alias("message")))
    sides = ledger.select("fingerprint", C("session_key").alias("l_session"), C("affects_completeness").alias("l_affects"))
    known = known.join(sides, "fingerprint", "left").join(about, "fingerprint", "left")
    anomalies = stored("anomalies", known.select("fingerprint", F.coalesce("l_session", "session_key").alias("session_key"), F.coalesce("l_affects", F.lit(False)).alias("affects_completeness"), "first_seen", "last_seen", "occurrences", "resolved_at", "message"))
    stored("sessions", session_outcomes(sessions, stopped, anomalies, probes))
    _publish(spark, root, run_id, folder)
    return True


def session_outcomes(sessions: DataFrame, stopped: DataFrame, anomalies: DataFrame, probes: DataFrame) -> DataFrame:
    """(session_key, inventory_status, stopped_at): a session with a failed entity or an open anomaly that affects completeness is incomplete; failed probes are errors."""
    gaps = anomalies.where("affects_completeness and resolved_at is null").groupBy("session_key").agg(F.lit(True).alias("gap"))
    failed = probes.groupBy("session_key").agg(F.sum("failed").alias("failed"))
    both = sessions.join(stopped.select("session_key", C("entity").alias("stopped_at")), "session_key", "left").join(gaps, "session_key", "left").join(failed, "session_key", "left")
    status = rollups.completeness(C("stopped_at").isNotNull() | C("gap").isNotNull(), F.coalesce("failed", F.lit(0)) > 0)
    return both.select("session_key", status.alias("inventory_status"), "stopped_at")


def _runs(spark: SparkSession, root: str) -> list[int]:
    return [int(name[4:]) for name in _names(spark, f"{root}/current") if name.startswith("run=")]


def _publish(spark: SparkSession, root: str, run_id: int, folder: str) -> None:
    """One pointer for all tables, renamed into place."""
    aside = f"{root}/pending/{uuid.uuid4().hex}"
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.json(aside)
    files, at, path = _files(spark, aside)
    files.mkdirs(path(f"{root}/current"))
    if not files.rename(at, path(f"{root}/current/run={run_id}")):
        raise OSError(f"run {run_id} could not be published")


def table(spark: SparkSession, root: str, name: str, run_id: int | None = None) -> DataFrame:
    """A table as a run has published it, the last run by default. A run that was lost before it was published is never seen."""
    runs = _runs(spark, root)
    if not runs:
        raise ValueError(f"no run has been published under {root}")
    folder = spark.read.schema("folder string").json(f"{root}/current/run={max(runs) if run_id is None else run_id}").first()[0]
    kept = {e.name for e in ENTITIES if e.tracked}
    return spark.read.parquet(f"{folder}/merge-{name}").drop("findings") if name in kept else spark.read.parquet(f"{folder}/{name}")
