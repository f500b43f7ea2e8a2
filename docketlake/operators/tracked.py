"""Merges of what a source shows over time: one join gives the next rows and everything that has changed, as typed findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: How a classification names what it does not know.
UNCLASSIFIED = ["unrecognized_raw_document_type", "unclassified"]
#: Kinds of findings.
PRESENCE, RAW_TYPE, KIND, UNKNOWN = "presence_changed", "raw_document_type_changed", "normalized_document_kind_changed", "unknown_document_type"
#: Columns that the rules below decide, whatever the source says.
DECIDED = ("source_presence", "missing_since", "first_seen_at", "last_seen_at", "download_status", "document_kind")


def merge_tracked(target: DataFrame, incoming: DataFrame, keys: list[str], now: Column, whole: DataFrame | None = None, scope: Column | None = None) -> DataFrame:
    """target's columns after incoming rows, and findings: array of (finding, previous, current). Rows that nothing touches have none.

    Columns that incoming has are taken from it; first_seen_at stays, last_seen_at moves, others of known rows are kept. A row that is seen has its
    incoming source_presence, active if none. A known row that is not seen becomes missing (since now, or since its first miss) if its session was read in
    full (`whole`: session_key), it is in scope, and it is not from pages only (origin `page_only`); a read in part proves presence and no absence.

    Of documents (rows with a document_kind): the kind of a known row stays where none comes, `unknown` is the last resort; one that was downloaded and whose
    url or source_modified_at comes and differs is changed_remote; a new one has its incoming initial_status, else discovered. Findings besides the change of presence: the raw type changed (both
    given), the kind changed, the kind or the classification_method is unknown. incoming has one row a key; null keys match nothing.
    """
    new = incoming.select(*[C(c).alias(f"n_{c}") for c in incoming.columns], F.lit(True).alias("is_new"))
    old = target.withColumn("is_old", F.lit(True))
    both = old.join(new, [C(k) == C(f"n_{k}") for k in keys], "full_outer")
    absent = F.lit(False)
    if whole is not None:
        both = both.join(whole.select(C("session_key").alias("w_session"), F.lit(True).alias("in_whole")).distinct(), C("session_key") == C("w_session"), "left")
        absent = C("in_whole").isNotNull() & (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False)))
        if "origin" in target.columns:
            absent = absent & ~C("origin").eqNullSafe("page_only")
    is_old, is_new = C("is_old").isNotNull(), C("is_new").isNotNull()
    given = lambda c: C(f"n_{c}") if c in incoming.columns else F.lit(None).cast(target.schema[c].dataType if c in target.columns else "string")
    presence = F.when(is_new, F.coalesce(given("source_presence"), F.lit("active"))).when(absent, "missing").otherwise(C("source_presence"))
    out = {
        "source_presence": presence,
        "missing_since": F.when(presence == "missing", F.coalesce("missing_since", now)).when(~is_new, C("missing_since")),
        "first_seen_at": F.when(is_old, C("first_seen_at")).otherwise(now),
        "last_seen_at": F.when(is_new, now).otherwise(C("last_seen_at")),
    }
    finding = lambda kind, when, a, b: F.when(when, F.struct(F.lit(kind).alias("finding"), a.cast("string").alias("previous"), b.cast("string").alias("current")))
    nothing = F.lit(None)
    findings = [finding(PRESENCE, is_old & (C("source_presence") != presence), C("source_presence"), presence)]
    if "document_kind" in target.columns:
        differs = lambda c: F.coalesce(F.trim(given(c).cast("string")) != F.coalesce(F.trim(C(c).cast("string")), F.lit("")), F.lit(False))
        kind = F.coalesce(given("document_kind"), C("document_kind"), F.lit("unknown"))
        out["document_kind"] = kind
        out["download_status"] = F.when(~is_old, F.coalesce(given("initial_status"), F.lit("discovered"))).when(is_new & (C("download_status") == "downloaded") & (differs("url") | differs("source_modified_at")), "changed_remote").otherwise(C("download_status"))
        raw = given("raw_document_type")
        findings += [
            finding(RAW_TYPE, is_old & is_new & (C("raw_document_type") != raw), C("raw_document_type"), raw),
            finding(KIND, is_old & is_new & (C("document_kind") != kind), C("document_kind"), kind),
            finding(UNKNOWN, is_new & ((kind == "unknown") | given("classification_method").isin(UNCLASSIFIED)), nothing, F.coalesce(raw, kind)),
        ]
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.coalesce(c, f"n_{c}").alias(c))
        elif c in out:
            columns.append(out[c].alias(c))
        elif c in incoming.columns and c not in DECIDED:
            columns.append(F.when(is_new, C(f"n_{c}")).otherwise(C(c)).alias(c))
        else:
            columns.append(C(c))
    return both.select(*columns, F.array_compact(F.array(*findings)).alias("findings"))


def findings_of(merged: DataFrame, keys: list[str], kind: str | None = None) -> DataFrame:
    """(keys, finding, previous, current): the typed findings of a merge, or those of one kind."""
    found = merged.select(*keys, F.explode("findings").alias("x")).select(*keys, "x.*")
    return found if kind is None else found.where(C("finding") == kind).drop("finding")
