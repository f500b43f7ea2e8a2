"""Roll-ups: one conditional aggregate per base table, joined on the session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.text import blank
from docketlake.operators.filters import PAYLOAD_KINDS, RETRYABLE

C = F.col


def when_sum(value: Column, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")


def session_status(sessions: DataFrame, bills: DataFrame, docs: DataFrame, probes: DataFrame) -> DataFrame:
    """One row per session: counts of measures, documents by kind and state, and known, unknown and archived sizes.

    Each base table is aggregated once; documents meet their session through the bill and their size
    through the latest probe, both by key, before one grouped aggregate with map-side combine.
    """
    present = bills.where("source_presence <> 'missing'")
    measures = present.groupBy("session_key").agg(
        F.count_if(C("measure_prefix") == "HB").alias("hb_count"),
        F.count_if(C("measure_prefix") == "SB").alias("sb_count"),
        F.count_if(C("bill_chamber") == "House").alias("house_measure_count"),
        F.count_if(C("bill_chamber") == "Senate").alias("senate_measure_count"),
    )
    placed = docs.join(bills.select("bill_id", "session_key"), "bill_id").join(probes.groupBy("doc_key").agg(F.max("content_length").alias("content_length"), F.lit(True).alias("probed")), "doc_key", "left")
    current = C("source_presence") != "missing"
    downloadable = current & ~blank(C("canonical_download_url")) & (C("download_status") != "not_applicable")
    files = placed.groupBy("session_key").agg(
        F.count_if(current & (C("document_kind") == "public_testimony")).alias("public_testimony_count"),
        F.count_if(current & C("document_kind").isin("committee_presentation", "legacy_testimony")).alias("presentation_legacy_count"),
        F.count_if(current & (C("document_kind") == "floor_letter")).alias("floor_letter_count"),
        F.count_if(current).alias("document_count"),
        F.count_if(downloadable).alias("downloadable_count"),
        F.count_if(current & (C("download_status") == "downloaded")).alias("downloaded_count"),
        F.count_if(current & C("download_status").isin("failed_retryable", "failed_terminal")).alias("failure_count"),
        F.count_if(current & (C("document_kind") == "unknown")).alias("unknown_count"),
        when_sum(C("content_length"), current).alias("known_remote_bytes"),
        F.count_if(current & C("content_length").isNotNull()).alias("known_size_count"),
        F.count_if(downloadable & C("content_length").isNull()).alias("unknown_size_count"),
        when_sum(C("downloaded_bytes"), C("download_status") == "downloaded").alias("local_archive_bytes"),
    )
    joined = sessions.select("session_key", "begin_date").join(measures, "session_key", "left").join(files, "session_key", "left")
    counts = [c for c in joined.columns if c not in ("session_key", "begin_date")]
    return joined.select("session_key", "begin_date", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


def preflight(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """One row: what a download run over the payload kinds would meet, with known bytes and a lower-bound flag."""
    scope = docs.where(C("document_kind").isin(PAYLOAD_KINDS)).join(probes.groupBy("doc_key").agg(F.max("content_length").alias("content_length")), "doc_key", "left")
    has_url, status = ~blank(C("canonical_download_url")), C("download_status")
    todo = has_url & status.isin(RETRYABLE)
    return scope.agg(
        F.count("*").alias("in_scope"),
        F.count_if(status == "downloaded").alias("downloaded"),
        F.count_if(has_url & status.isin("discovered", "queued")).alias("pending"),
        F.count_if(has_url & status.isin("failed_retryable", "changed_remote")).alias("retryable"),
        F.count_if(~has_url | status.isin("failed_terminal", "not_applicable")).alias("terminal"),
        when_sum(C("content_length"), todo).alias("known_bytes"),
        F.count_if(todo & C("content_length").isNull()).alias("unknown_sizes"),
        F.coalesce(F.bool_or(todo & C("content_length").isNull()), F.lit(False)).alias("is_lower_bound"),
    )


def one_row(frames: list[DataFrame]) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def run_outcome(statuses: DataFrame, errors: DataFrame) -> DataFrame:
    """(run_id, outcome): failed if nothing completed and a terminal failure exists; with errors if anything failed or stays open; else completed."""
    counts = statuses.groupBy("run_id").agg(F.count_if(C("status") == "completed").alias("done"), F.count_if(C("status") == "failed_terminal").alias("fatal"), F.count_if(C("status").startswith("failed")).alias("failed"))
    open_ = errors.where("resolved_at is null").groupBy("run_id").agg(F.count("*").alias("open_errors"))
    outcome = F.when((C("done") == 0) & (C("fatal") > 0), "failed").when((C("failed") > 0) | (F.coalesce("open_errors", F.lit(0)) > 0), "completed_with_errors").otherwise("completed")
    return counts.join(open_, "run_id", "left").select("run_id", outcome.alias("outcome"))


def completeness(material_gap: Column, probe_failures: Column) -> Column:
    return F.when(material_gap, "inventory_incomplete").when(probe_failures, "inventory_complete_with_errors").otherwise("inventory_complete")


def dashboard(sessions: DataFrame, boundary: str, states: DataFrame, bills: DataFrame, docs: DataFrame, probes: DataFrame, runs: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of the archive's scalars; archive_bytes is the size of all versions. Without the boundary session, no session is in scope."""
    since = sessions.where(C("session_key") == boundary).agg(F.min("begin_date").alias("since"))  # one row
    sized = docs.join(probes.groupBy("doc_key").agg(F.max("content_length").alias("size")), "doc_key", "left")
    current, kind, status = C("source_presence") != "missing", C("document_kind"), C("download_status")
    done = C("run_type").eqNullSafe("inventory_backfill") & C("status").isin("completed", "completed_with_errors")
    return one_row([
        sessions.crossJoin(F.broadcast(since)).agg(F.count_if(C("begin_date") >= C("since")).alias("sessions_in_scope")),
        states.agg(F.count_if(C("inventory_status").isin("inventory_complete", "inventory_complete_with_errors")).alias("sessions_inventory_complete")),
        bills.agg(F.count("*").alias("bills")),
        sized.agg(
            F.count("*").alias("documents_discovered"),
            F.count_if(kind == "public_testimony").alias("public_testimony"),
            F.count_if(kind.isin("legacy_testimony", "committee_presentation")).alias("presentation_legacy"),
            F.count_if(kind == "floor_letter").alias("floor_letters"),
            F.count_if((status == "downloaded") & (C("validation_status") == "valid") & C("has_version")).alias("documents_downloaded"),
            F.count_if(status.isin("failed_retryable", "failed_terminal")).alias("download_failures"),
            when_sum(C("size"), current).alias("known_remote_bytes"),
            F.count_if(current & C("size").isNotNull()).alias("known_size_documents"),
            F.count_if(current & ~blank(C("canonical_download_url")) & C("size").isNull()).alias("unknown_size_documents"),
        ),
        versions.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("archive_bytes")),
        runs.agg(F.max(F.when(done, C("finished_at"))).alias("last_historical_inventory")),
    ])


def finished_runs(runs: DataFrame, items: DataFrame, historical: list[str]) -> DataFrame:
    """(run_id, outcome) of runs that end now: canceled and paused stay; fatal without any bill (null counts as 0) is failed; errors, or
    sessions that a historical run left incomplete or failed, are completed_with_errors; else completed."""
    failed = items.where((C("item_type") == "session") & C("status").isin("failed_retryable", "failed_terminal")).groupBy("run_id").agg(F.count("*").alias("failed_sessions"))
    left_open = (C("sessions_incomplete") > 0) | (C("sessions_failed") > 0) | (F.coalesce("failed_sessions", F.lit(0)) > 0)
    errors = (C("error_count") > 0) | C("run_type").isin(historical) & left_open
    outcome = F.when(C("status").isin("canceled", "paused"), C("status")).when(C("fatal_error").isNotNull() & (F.coalesce("bills_completed", F.lit(0)) == 0), "failed").when(errors, "completed_with_errors").otherwise("completed")
    return runs.join(failed, "run_id", "left").select("run_id", outcome.alias("outcome"))


def newest_of_each(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each key in an order that leaves no ties. Spark keeps only `limit` rows a key and task before it shuffles."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(C("rn_") <= limit).drop("rn_")


def bill_details(sponsors: DataFrame, docs: DataFrame, agenda: DataFrame) -> DataFrame:
    """(bill_id, part, section, entries, n): sponsors by bucket in print order, documents by kind, agenda by date.

    sponsors: bill_id, section, print_order, name and more columns to break ties. Each list is one bill's section.
    """

    def listed(rows: DataFrame, part: str, section: Column, value: str, order: list[Column | str]) -> DataFrame:
        sorted_rows = F.sort_array(F.collect_list(F.struct(*[c if isinstance(c, str) else c.alias(f"o{k}") for k, c in enumerate(order)], C(value).cast("string").alias("entry"))))
        return rows.groupBy("bill_id", section.alias("section")).agg(F.array_join(F.transform(sorted_rows, lambda x: x["entry"]), ",").alias("entries"), F.count("*").alias("n")).select("bill_id", F.lit(part).alias("part"), "section", "entries", "n")

    ties = [c for c in sponsors.columns if c not in ("bill_id", "section", "print_order", "name")]
    by_order = listed(sponsors, "sponsors", C("section"), "name", [F.coalesce("print_order", F.lit(2147483647)), C("name"), *ties])
    return by_order.union(listed(docs, "documents", C("document_kind"), "doc_key", ["doc_key"])).union(listed(agenda, "agenda", F.lit("agenda"), "at", ["at", "ident"]))
