"""Keyed merges of snapshots. Each takes a snapshot and new rows and gives the next snapshot; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def merge_keyed(target: DataFrame, source: DataFrame, keys: list[str], preserve: list[str] = ()) -> DataFrame:
    """Insert or update by key: columns the source has are taken from it, but for preserved ones of existing rows; others stay.

    The source has one row a key. A full outer join on the key; rows only in the target are unchanged.
    """
    new = source.select(*[C(c).alias(f"new_{c}") for c in source.columns], F.lit(True).alias("in_source"))
    old = target.withColumn("in_target", F.lit(True))
    on = [C(k) == C(f"new_{k}") for k in keys]
    both = old.join(new, on, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(c, f"new_{c}").alias(c))
        elif c not in source.columns:
            out.append(C(c))
        elif c in preserve:
            out.append(F.when(C("in_target"), C(c)).otherwise(C(f"new_{c}")).alias(c))
        else:
            out.append(F.when(C("in_source"), C(f"new_{c}")).otherwise(C(c)).alias(c))
    return both.select(*out)


def presence(existing: DataFrame, observed: DataFrame, key: str, complete: bool, now: Column, exempt: Column | None = None) -> DataFrame:
    """(key, presence, missing_since, reconciled_at, transition) of existing (key, presence, missing_since) against observed keys.

    Only a complete read may prove absence; any read proves presence. Known rows that are exempt (documents that only pages show) are left as they are.
    """
    both = existing.withColumn("was", F.lit(True)).withColumn("exempt_", F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))).join(observed.select(key).distinct().withColumn("seen", F.lit(True)), key, "full_outer")
    was, seen, full = C("was").isNotNull(), C("seen").isNotNull(), F.lit(complete) & ~F.coalesce("exempt_", F.lit(False))
    state = F.when(seen, "active").when(full, "missing").otherwise(C("presence"))
    since = F.when(seen, None).when(full, F.coalesce("missing_since", now)).otherwise(C("missing_since"))
    transition = F.when(~was, "new").when(seen & (C("presence") == "missing"), "reappeared").when(~seen & full & (C("presence") != "missing"), "became_missing").otherwise("unchanged")
    return both.select(key, state.alias("presence"), since.alias("missing_since"), F.when(full, now).alias("reconciled_at"), transition.alias("transition"))


def ledger_merge(ledger: DataFrame, seen: DataFrame, batch: int | None = None) -> DataFrame:
    """Occurrence ledger (fingerprint, first_seen, last_seen, occurrences, resolved_at, message[, last_batch]) after new rows (fingerprint, at, message).

    New rows are grouped first, so a hot finding is one row a task. Occurrences add up, first_seen
    stays, last_seen moves, and a finding that recurs is open again. With a batch number, a fingerprint
    whose last_batch is not smaller is left alone: a replayed batch counts once.
    """
    fresh = seen.groupBy("fingerprint").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"), F.max_by("message", F.struct("at", "message")).alias("said"))
    both = ledger.join(fresh, "fingerprint", "full_outer")
    new = C("n").isNotNull() if batch is None else C("n").isNotNull() & (F.coalesce("last_batch", F.lit(-1)) < batch)
    out = both.select(
        "fingerprint",
        F.when(new, F.least("first_seen", "lo")).otherwise(C("first_seen")).alias("first_seen"),
        F.when(new, F.greatest("last_seen", "hi")).otherwise(C("last_seen")).alias("last_seen"),
        (F.coalesce("occurrences", F.lit(0)) + F.when(new, C("n")).otherwise(0)).alias("occurrences"),
        F.when(~new, C("resolved_at")).alias("resolved_at"),
        F.when(new, F.substring("said", 1, 2000)).otherwise(C("message")).alias("message"),
        *([] if batch is None else [F.when(new, F.lit(batch)).otherwise(C("last_batch")).alias("last_batch")]),
    )
    return out


def resolve(ledger: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """Open rows whose key is listed become resolved."""
    hit = ids.select(key).distinct().withColumn("hit", F.lit(True))
    return ledger.join(hit, key, "left").withColumn("resolved_at", F.coalesce("resolved_at", F.when(C("hit"), now))).drop("hit")


def commit_cursor(state: DataFrame, outcome: DataFrame) -> DataFrame:
    """Sync state (session_key, entity, cursor, complete, last_error) after load outcomes (session_key, entity, ok, new_cursor, error).

    Success advances the cursor (null keeps the old) and clears the error; failure never moves it.
    """
    both = state.join(outcome, ["session_key", "entity"], "full_outer")
    return both.select(
        "session_key",
        "entity",
        F.when(C("ok"), F.coalesce("new_cursor", "cursor")).otherwise(C("cursor")).alias("cursor"),
        F.when(C("ok").isNull(), C("complete")).otherwise(C("ok")).alias("complete"),
        F.when(C("ok").isNull(), C("last_error")).when(~C("ok"), C("error")).alias("last_error"),
    )


def document_changes(before: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents (id, url, date, status, raw_type) after incoming (id, url, date, raw_type), with changed and type_changed.

    A downloaded document whose URL or date is given and differs (null stored counts as empty) becomes
    changed_remote; a new one is discovered; the download state of others stays.
    """
    new = incoming.select("id", *[C(c).alias(f"new_{c}") for c in ("url", "date", "raw_type")], F.lit(True).alias("here"))
    both = before.join(new, "id", "full_outer")
    differs = lambda c: F.coalesce(F.trim(f"new_{c}") != F.coalesce(F.trim(c), F.lit("")), F.lit(False))
    changed = (C("status") == "downloaded") & (differs("url") | differs("date"))
    typed = F.coalesce(C("raw_type") != C("new_raw_type"), F.lit(False))
    return both.select("id", F.coalesce("new_url", "url").alias("url"), F.when(C("status").isNull(), "discovered").when(changed, "changed_remote").otherwise(C("status")).alias("status"), F.coalesce(changed, F.lit(False)).alias("changed"), typed.alias("type_changed"))


def drift(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, old, new) where a column of a row in both snapshots differs, nulls equal."""
    new = after.select(C(key).alias("key_"), *[C(c).alias(f"new_{c}") for c in columns])
    both = before.join(new, C(key) == C("key_"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), C(c).cast("string").alias("old"), C(f"new_{c}").cast("string").alias("new")) for c in columns])
    return both.select(key, F.explode(cells).alias("x")).select(key, "x.column", "x.old", "x.new").where(~C("old").eqNullSafe(C("new")))


def publish(snapshot: DataFrame, root: str, version: str) -> str:
    """Write a snapshot beside the old ones and point to it last: readers see the old one or the new one whole."""
    path = f"{root}/v={version}"
    snapshot.write.mode("errorifexists").parquet(path)
    snapshot.sparkSession.createDataFrame([(version, path)], "version string, path string").coalesce(1).write.mode("append").json(f"{root}/current")
    return path


def current(spark, root: str) -> DataFrame:
    """The published snapshot of the largest version."""
    path = spark.read.schema("version string, path string").json(f"{root}/current").agg(F.max_by("path", "version")).first()[0]
    return spark.read.parquet(path)


def redelivered(first: DataFrame, source: DataFrame, key: str, at: str, cursor: Column) -> DataFrame:
    """(key, last_at, deliveries) of a load and of the next one, which reads again all rows at or after the cursor: late rows are those delivered twice."""
    again = source.where(C(at) >= cursor)
    return first.select(key, at).union(again.select(key, at)).groupBy(key).agg(F.max(at).alias("last_at"), F.count("*").alias("deliveries"))
