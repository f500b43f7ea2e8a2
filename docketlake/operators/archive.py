"""Immutable versions, frozen lists of work, results of downloads, lookups and ordered lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.functions.text import blank
from docketlake.operators import filters, ranking
from docketlake.streaming.loads import _files

C = F.col


def append_versions(docs: DataFrame, known: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, documents) after payloads have arrived; versions are only ever added.

    docs: document, and the columns copied from the current version: current_version, sha256, size, status.
    known: document, version, sha256, size. arrived: document, sha256, size, seen (order of arrival). A hash
    that a document already has selects that version again; others get the next numbers. The last to arrive is current.
    """
    numbered = ranking.next_versions(arrived.select("document", "sha256", "seen"), known.select("document", "sha256", "version"))
    sized = arrived.groupBy("document", "sha256").agg(F.max("seen").alias("seen"), F.max_by("size", "seen").alias("size"))
    found = numbered.join(sized, ["document", "sha256"])
    versions = known.select("document", "version", "sha256", "size").unionByName(found.where("is_new").select("document", C("version").cast("bigint").alias("version"), "sha256", "size"))
    now = found.groupBy("document").agg(F.max_by(F.struct("version", "sha256", "size"), "seen").alias("v"))
    joined = docs.join(now, "document", "left")
    copied = [F.coalesce(C("v.version"), C("current_version")).cast("bigint").alias("current_version"), F.coalesce("v.sha256", "sha256").alias("sha256"), F.coalesce("v.size", "size").alias("size"), F.when(C("v").isNotNull(), "downloaded").otherwise(C("status")).alias("status")]
    return versions, joined.select("document", *copied)


def retry_items(run: int, docs: DataFrame, bills: DataFrame, first_year: int, include_terminal: bool, source_items: DataFrame | None = None, session: str | None = None, bill: int | None = None) -> DataFrame:
    """The frozen items of a retry run: (run_id, item_type, item_key, bill_id, session_key, status), one a document; item_key is the document's key.

    source_items: (item_type, item_key) of the run whose documents are retried; without it, all eligible documents, of one session or bill if told.
    """
    found = filters.retry_eligible(docs, bills, first_year, include_terminal)
    if source_items is not None:
        found = found.join(source_items.where("item_type = 'document'").select("item_key"), C("doc_key") == C("item_key"), "left_semi")
    if session is not None:
        found = found.where(C("session_key") == session.strip().upper())
    if bill is not None:
        found = found.where(C("bill_id") == bill)
    return found.select(F.lit(run).cast("bigint").alias("run_id"), F.lit("document").alias("item_type"), C("doc_key").alias("item_key"), "bill_id", "session_key", F.lit("queued").alias("status")).distinct()


def work_list(scope: DataFrame, states: DataFrame, docs: DataFrame, bills: DataFrame, items: DataFrame, cutoff: Column, statuses: list[str], kinds: list[str], include_missing: bool = False) -> DataFrame:
    """Documents of a frozen archive run in the order of its sessions: (ordinal, session_key, doc_key).

    scope: session_key, ordinal. Only sessions whose inventory is complete count; documents are active or of unknown presence (missing ones if included), seen by the
    cutoff, of the chosen kinds and statuses, with a URL, and not themselves an item of the run yet (items: item_type, item_key); a sibling that is one hides nothing.
    """
    present = ["active", "unknown", *(["missing"] if include_missing else [])]
    taken = items.where("item_type = 'document'").select("item_key")
    ready = states.where(C("inventory_status").isin("inventory_complete", "inventory_complete_with_errors")).select("session_key")
    sessions = scope.join(ready, "session_key", "left_semi")
    fit = docs.where(C("document_kind").isin(kinds) & C("download_status").isin(statuses) & C("source_presence").isin(present) & (C("first_seen_at") <= cutoff) & ~blank(C("canonical_download_url")))
    placed = fit.join(bills.select("bill_id", "session_key"), "bill_id").join(sessions, "session_key")
    return placed.join(taken, C("doc_key") == C("item_key"), "left_anti").select("ordinal", "session_key", "doc_key").distinct()


def publish_list(rows: DataFrame, order: list[str], root: str, run: int) -> bool:
    """Freeze a list of work: rows numbered from 0 by `order`, written once; False if the run has one, which is never written again.

    The order is cut into ranges, each numbered by itself; only the ranges' sizes are put together, so no task sees the whole list. `order` leaves no ties.
    """
    spark = rows.sparkSession
    folder = f"{root}/lists/run={run}"
    files, at, path = _files(spark, folder)
    if files.exists(at):
        return False
    aside = f"{root}/pending/{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).write.parquet(f"{aside}/ranges")  # written, as ranges may differ when computed again
    held = spark.read.parquet(f"{aside}/ranges")
    sizes = held.groupBy("range_").agg(F.count("*").alias("n_"))  # a row a range
    before = sizes.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - C("n_")).alias("before_"))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    held.withColumn("place_", place).join(F.broadcast(before), "range_").withColumn("position", C("before_") + C("place_") - 1).drop("range_", "place_", "before_").write.parquet(f"{aside}/list")
    files.mkdirs(path(f"{root}/lists"))
    if files.exists(at) or not files.rename(path(f"{aside}/list"), at):
        return False
    files.delete(path(aside), True)
    return True


def listed(spark: SparkSession, root: str, run: int, after: int = -1, size: int | None = None) -> DataFrame:
    """The rows of a frozen list behind a position, `size` of them or all: a page is a range of positions, not a sort."""
    rows = spark.read.parquet(f"{root}/lists/run={run}").where(C("position") > after)
    return rows if size is None else rows.where(C("position") <= after + size)


def unlisted_sessions(asked: DataFrame, sessions: DataFrame, states: DataFrame) -> DataFrame:
    """(session_key, problem) of asked sessions that no run may take up: unknown, or not started."""
    known = asked.join(sessions.select("session_key", F.lit(True).alias("known_")), "session_key", "left").join(states.select("session_key", "inventory_status"), "session_key", "left")
    problem = F.when(C("known_").isNull(), "unknown").when(F.coalesce("inventory_status", F.lit("not_started")) == "not_started", "not_started")
    return known.select("session_key", problem.alias("problem")).where("problem is not null")


def download_result(status: Column, attempt: Column, file_valid: Column, source_changed: Column, retry_terminal: bool) -> Column:
    """What a run makes of a document: an unchanged valid file is skipped, a terminal failure is preserved unless a retry is asked for,
    an attempt that failed is retryable or terminal by its cause, one that succeeded is downloaded, and what was not tried is queued."""
    out = F.when(file_valid & ~source_changed, "skipped_valid")
    if not retry_terminal:
        out = out.when(status == "failed_terminal", "preserved_terminal")
    return out.when(attempt.isin("timeout", "http_5xx", "http_429", "low_space", "interrupted"), "failed_retryable").when(attempt.isin("http_404", "http_403", "html_instead_of_file", "invalid_signature"), "failed_terminal").when(attempt == "ok", "downloaded").otherwise("queued")


#: Failures of a transfer that say that the file itself is wrong.
INVALID_FILE = ["validation_failed", "content_length_mismatch"]


def download_states(docs: DataFrame, attempts: DataFrame, retry_terminal: bool) -> DataFrame:
    """(doc_key, queued_from, status, validation_status, item_status, error, preserved) of a run's documents.

    docs: doc_key, download_status, validation_status, file_valid, source_changed, last_error. attempts: doc_key, attempt, ok, code, retryable, message; the last one decides.
    A valid file of an unchanged source is skipped. A terminal failure is preserved with its error unless a retry is asked for, which starts as failed_retryable. A downloaded
    document whose file is valid is queued as changed_remote, one whose file is not as missing_local. A transfer that failed is retryable or terminal as told, and its file
    invalid only where the code says so; one that succeeded is downloaded and valid; what was not tried waits as queued. A low disk and an interruption pause.
    """
    last = attempts.groupBy("doc_key").agg(F.max_by(F.struct("ok", "code", "retryable", "message"), "attempt").alias("a"))
    rows = docs.join(last, "doc_key", "left")
    status, valid, changed = C("download_status"), F.coalesce("file_valid", F.lit(False)), F.coalesce("source_changed", F.lit(False))
    skipped, preserved = valid & ~changed, (status == "failed_terminal") & F.lit(not retry_terminal)
    queued = F.when(status == "downloaded", F.when(valid, "changed_remote").otherwise("missing_local")).when(status == "failed_terminal", "failed_retryable").otherwise(status)
    tried = C("a").isNotNull()
    after = F.when(C("a.ok"), "downloaded").when(C("a.code") == "low_space", "paused_low_space").when(C("a.code") == "interrupted", "interrupted").when(C("a.retryable"), "failed_retryable").otherwise("failed_terminal")
    checked = F.when(C("a.ok"), "valid").when(C("a.code").isin(INVALID_FILE), "invalid").otherwise("not_validated")
    pick = lambda skip, keep, new, wait: F.when(skipped, skip).when(preserved, keep).when(tried, new).otherwise(wait)
    none = F.lit(None).cast("string")
    return rows.select(
        "doc_key",
        pick(none, none, queued, queued).alias("queued_from"),
        pick(status, status, after, F.lit("queued")).alias("status"),
        pick(C("validation_status"), C("validation_status"), checked, C("validation_status")).alias("validation_status"),
        pick(F.lit("skipped"), F.lit("failed_terminal"), F.when(after == "downloaded", "completed").otherwise(after), F.lit("queued")).alias("item_status"),
        pick(none, F.coalesce("last_error", F.lit("previously recorded terminal failure")), F.when(~C("a.ok"), C("a.message")), none).alias("error"),
        (~skipped & preserved).alias("preserved"),
    )


def session_downloads(docs: DataFrame, bills: DataFrame) -> DataFrame:
    """(session_key, outcome): retryable failures before terminal ones before completed."""
    both = docs.join(bills.select("bill_id", "session_key"), "bill_id")
    outcome = F.when(F.bool_or(C("download_status") == "failed_retryable"), "retryable").when(F.bool_or(C("download_status") == "failed_terminal"), "terminal").otherwise("completed")
    return both.groupBy("session_key").agg(outcome.alias("outcome"))


def cursor_text(rows: DataFrame, prior: DataFrame, key: str, raw: str, ordinal: str) -> DataFrame:
    """(key, cursor): the raw text of the latest date of each key, of equal ones the first; an earlier cursor (key, cursor) counts, before all rows."""
    every = rows.select(key, C(raw).alias("raw"), C(ordinal).cast("bigint").alias("o")).unionByName(prior.select(key, C("cursor").alias("raw"), F.lit(-1).cast("bigint").alias("o")))
    return every.withColumn("parsed", F.try_to_timestamp("raw")).where("parsed is not null").groupBy(key).agg(F.max_by("raw", F.struct("parsed", -C("o"))).alias("cursor"))


def ordered_keys(lists: DataFrame, key: str, values: str) -> DataFrame:
    """Lists of keys without repetition: each trimmed, upper-cased key where it stands first; blanks go. Lists are short; each is one row."""
    clean = F.filter(F.transform(values, lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    return lists.select(key, F.array_distinct(clean).alias(values))


def last_of_sources(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key over several sources of documents; the last source that has it gives all its columns. Columns that a source lacks are null."""
    every = None
    for place, rows in enumerate(sources):
        rows = rows.withColumn("source_", F.lit(place))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (*keys, "source_")]
    value = F.struct(*rest)
    return every.groupBy(*keys).agg(F.max_by(value, F.struct("source_", value)).alias("r")).select(*keys, "r.*")


def children(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(resolved, errors): rows with a parent, and an error for each without one."""
    errors = rows.join(parents, key, "left_anti").select(*rows.columns, F.concat(F.lit("no parent for "), C(key).cast("string")).alias("message"))
    return rows.join(parents, key), errors


def placed(rows: DataFrame, within: str, order: list[Column]) -> DataFrame:
    """rows with place, from 1, in an order within a group of moderate size (a bill's documents, a session's committees)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*order)))
