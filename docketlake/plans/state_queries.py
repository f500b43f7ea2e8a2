"""Queries of merges, reconciliation, planning and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions import text as X
from docketlake.operators import filters, merge, quality, reconcile, rollups
from docketlake.plans.registry import query
from docketlake.plans.standins import Tables

C = F.col


def _now() -> Column:
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


_NOW = "TIMESTAMP '2024-06-01 00:00:00'"


@query("SELECT coalesce(b.k, a.k) AS k, CASE WHEN a.k IS NULL THEN b.v ELSE a.v END AS v, CASE WHEN b.k IS NULL THEN a.d ELSE b.d END AS d FROM before b FULL JOIN after a ON a.k = b.k")
def a13_merge_keyed(t: Tables) -> DataFrame:
    return merge.merge_keyed(t.before, t.after, ["k"], preserve=["d"])


_PRESENCE = """SELECT coalesce(b.k, a.k) AS k, CASE WHEN a.k IS NOT NULL THEN 'active' WHEN {full} THEN 'missing' ELSE b.p END AS presence, CASE WHEN a.k IS NOT NULL THEN NULL WHEN {full} THEN coalesce(b.m, {now}) ELSE b.m END AS missing_since, CASE WHEN {full} THEN {now} END AS reconciled_at,
CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NOT NULL AND b.p = 'missing' THEN 'reappeared' WHEN a.k IS NULL AND {full} AND b.p <> 'missing' THEN 'became_missing' ELSE 'unchanged' END AS transition
FROM (SELECT k, CASE CAST(k % 4 AS INT) WHEN 0 THEN 'missing' WHEN 1 THEN 'unknown' ELSE 'active' END AS p, CASE WHEN k % 4 = 0 THEN d END AS m FROM before) b FULL JOIN after a ON a.k = b.k"""


def _existing(t: Tables) -> DataFrame:
    k = C("k") % 4
    return t.before.select("k", F.when(k == 0, "missing").when(k == 1, "unknown").otherwise("active").alias("presence"), F.when(k == 0, C("d")).alias("missing_since"))


@query(_PRESENCE.format(full="true", now=_NOW))
def d8_presence(t: Tables) -> DataFrame:
    return merge.presence(_existing(t), t.after, "k", True, _now())


@query(_PRESENCE.format(full="false", now=_NOW))
def s5_presence_incremental(t: Tables) -> DataFrame:
    return merge.presence(_existing(t), t.after, "k", False, _now())


@query(f"SELECT transition, count(*) AS n FROM ({_PRESENCE.format(full='true', now=_NOW)}) GROUP BY 1")
def e12_transitions(t: Tables) -> DataFrame:
    return d8_presence(t).groupBy("transition").agg(F.count("*").alias("n"))


@query(f"SELECT k, transition FROM ({_PRESENCE.format(full='true', now=_NOW)}) WHERE transition <> 'unchanged'")
def s12_presence_events(t: Tables) -> DataFrame:
    return d8_presence(t).where("transition <> 'unchanged'").select("k", "transition")


_DISPLAY = """SELECT coalesce(s.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'source_only' WHEN s.id IS NULL THEN 'page_only' ELSE 'both' END AS origin,
CASE WHEN p.id IS NOT NULL THEN true WHEN coalesce(s.id, p.id) % 3 <> 0 THEN false END AS displayed, CASE WHEN s.id IS NULL THEN 'unknown' ELSE 'active' END AS presence,
CASE WHEN p.id IS NOT NULL OR coalesce(s.id, p.id) % 3 <> 0 THEN {now} END AS display_reconciled_at, {reclassified} AS reclassified FROM source_side s FULL JOIN page_side p ON s.id = p.id"""
def _outcome() -> Column:
    return F.when(C("id") % 3 == 0, "failed_fetch").when(C("id") % 3 == 1, "checked_zero").otherwise("checked_with_records")


@query(_DISPLAY.format(now=_NOW, reclassified="false"))
def d9_testimony(t: Tables) -> DataFrame:
    return reconcile.two_sources(t.source_side.select("id"), t.page_side, "id", _outcome(), _now())


@query(_DISPLAY.format(now=_NOW, reclassified="s.id IS NOT NULL AND p.id IS NOT NULL AND s.id % 2 = 1"))
def d10_presentations(t: Tables) -> DataFrame:
    return reconcile.two_sources(t.source_side.select("id"), t.page_side, "id", _outcome(), _now(), expected=C("id") % 2 == 0)


@query("""WITH st AS (SELECT session_key, 'measures' AS entity, max(source_modified_at) AS cursor FROM bill WHERE bill_id % 2 = 0 AND session_key <> '1998R1' GROUP BY 1), o AS (SELECT session_key, 'measures' AS entity, session_key <> '1996R1' AS ok, max(source_modified_at) AS c FROM bill WHERE session_key <> '1997R1' GROUP BY 1)
SELECT coalesce(st.session_key, o.session_key) AS session_key, 'measures' AS entity, CASE WHEN o.ok THEN coalesce(o.c, st.cursor) ELSE st.cursor END AS cursor, CASE WHEN o.ok IS NULL THEN true ELSE o.ok END AS complete, CASE WHEN NOT o.ok THEN 'timeout' END AS last_error FROM st FULL JOIN o ON st.session_key = o.session_key""")
def s1_commit_cursor(t: Tables) -> DataFrame:
    bills = t.bill
    state = bills.where("bill_id % 2 = 0 and session_key <> '1998R1'").groupBy("session_key").agg(F.lit("measures").alias("entity"), F.max("source_modified_at").alias("cursor"), F.lit(True).alias("complete"), F.lit(None).cast("string").alias("last_error"))
    outcome = bills.where("session_key <> '1997R1'").groupBy("session_key").agg(F.lit("measures").alias("entity"), (C("session_key") != "1996R1").alias("ok"), F.max("source_modified_at").alias("new_cursor"), F.lit("timeout").alias("error"))
    return merge.commit_cursor(state, outcome)


@query("SELECT id, max(seen_at) AS last_at, count(*) AS deliveries FROM (SELECT user_id * 31 + event_id % 50 AS id, ts AS seen_at FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id * 31 + event_id % 50, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03') GROUP BY 1")
def s3_overlap_dedupe(t: Tables) -> DataFrame:
    ident = (C("user_id") * 31 + C("event_id") % 50).alias("id")
    rows = t.events.where("event_id % 2 = 0").select(ident, C("ts").alias("at")).union(t.events.where("ts >= timestamp '2024-01-03'").select(ident, C("ts")))
    return rows.groupBy("id").agg(F.max("at").alias("last_at"), F.count("*").alias("deliveries"))


@query("""SELECT coalesce(b.k, a.k) AS id, coalesce(a.v, b.v) AS url, CASE WHEN b.k IS NULL THEN 'discovered' WHEN b.k % 2 = 0 AND a.k IS NOT NULL AND a.v <> b.v THEN 'changed_remote' WHEN b.k % 2 = 0 THEN 'downloaded' ELSE 'queued' END AS status, coalesce(b.k % 2 = 0 AND a.v <> b.v, false) AS changed, coalesce(a.v <> b.v, false) AS type_changed FROM before b FULL JOIN after a ON a.k = b.k""")
def s6_document_merge(t: Tables) -> DataFrame:
    before = t.before.select(C("k").alias("id"), C("v").alias("url"), C("d").cast("string").alias("date"), F.when(C("k") % 2 == 0, "downloaded").otherwise("queued").alias("status"), C("v").alias("raw_type"))
    return merge.document_changes(before, t.after.select(C("k").alias("id"), C("v").alias("url"), C("d").cast("string").alias("date"), C("v").alias("raw_type")))


@query("SELECT k, count(*) AS n, bool_or(chamber_ok) AS chamber_ok FROM (SELECT b.k, (b.k % 2 = 0) = (bill_chamber = 'House') AS chamber_ok FROM before b JOIN bill ON bill_id = k) GROUP BY 1")
def s7_bill_merge(t: Tables) -> DataFrame:
    ok = (C("k") % 2 == 0) == (C("bill_chamber") == "House")
    return t.before.join(t.bill, C("bill_id") == C("k")).groupBy("k").agg(F.count("*").alias("n"), F.bool_or(ok).alias("chamber_ok"))


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, c_nationkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def s8_reference_merge(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", C("c_name").alias("name"), "c_nationkey")
    source = t.supplier.join(t.customer.select("c_custkey"), C("s_suppkey") == C("c_custkey"), "left_semi").select(C("s_suppkey").alias("c_custkey"), C("s_name").alias("name"))
    return merge.merge_keyed(target, source, ["c_custkey"])


_FP = "sha256(concat_ws(chr(31), event_type, CAST(user_id AS VARCHAR)))"


@query(f"""WITH l AS (SELECT {_FP} AS fp, min(ts) AS f, max(ts) AS m, count(*) AS n, max(ts) AS r, arg_max(props, event_id) AS msg FROM events WHERE event_id < 6000 AND user_id % 3 <> 0 GROUP BY 1), s AS (SELECT {_FP} AS fp, min(ts) AS lo, max(ts) AS hi, count(*) AS n, arg_max(props, event_id) AS msg FROM events WHERE event_id >= 6000 AND user_id % 5 <> 0 GROUP BY 1)
SELECT coalesce(l.fp, s.fp) AS fingerprint, coalesce(f, lo) AS first_seen, coalesce(hi, m) AS last_seen, coalesce(l.n, 0) + coalesce(s.n, 0) AS occurrences, CASE WHEN s.fp IS NULL THEN r END AS resolved_at, coalesce(s.msg, l.msg) AS message FROM l FULL JOIN s ON l.fp = s.fp""")
def s9_anomaly_ledger(t: Tables) -> DataFrame:
    rows = t.events.withColumn("fingerprint", X.fingerprint([C("event_type"), C("user_id")]))
    ledger = rows.where("event_id < 6000 and user_id % 3 <> 0").groupBy("fingerprint").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"), F.max("ts").alias("resolved_at"), F.max_by("props", "event_id").alias("message"))
    return merge.ledger_merge(ledger, rows.where("event_id >= 6000 and user_id % 5 <> 0").select("fingerprint", C("ts").alias("at"), C("props").alias("message")))


@query("SELECT sha256(concat_ws('|', CAST(run_id AS VARCHAR), '', message)) AS fingerprint, run_id, count(*) AS occurrences, min(last_occurred_at) AS first_seen FROM err GROUP BY 1, 2")
def s10_error_ledger(t: Tables) -> DataFrame:
    fp = X.fingerprint([C("run_id"), F.lit(None).cast("string"), C("message")], "|")
    return t.err.groupBy(fp.alias("fingerprint"), "run_id").agg(F.count("*").alias("occurrences"), F.min("last_occurred_at").alias("first_seen"))


@query(f"SELECT id, run_id, CASE WHEN resolved_at IS NULL AND run_id IN (SELECT run_id FROM item WHERE status = 'completed' AND ts < TIMESTAMP '2024-01-01 08:00:00') THEN {_NOW} ELSE resolved_at END AS resolved_at FROM err")
def s11_resolution(t: Tables) -> DataFrame:
    return merge.resolve(t.err, t.item.where("status = 'completed' and ts < timestamp '2024-01-01 08:00:00'"), "run_id", _now()).select("id", "run_id", "resolved_at")


@query("SELECT bill_id, document_kind AS family, max(first_seen_at) AS checked_at, arg_max(displayed, epoch_us(first_seen_at) * 8 + source_id % 8) AS displayed FROM (SELECT DISTINCT bill_id, document_kind, first_seen_at, source_id, displayed FROM doc WHERE displayed IS NOT NULL) GROUP BY 1, 2")
def s13_display_state(t: Tables) -> DataFrame:
    return t.doc.where("displayed is not null").groupBy("bill_id", C("document_kind").alias("family")).agg(F.max("first_seen_at").alias("checked_at"), F.max_by("displayed", F.struct("first_seen_at", "source_id")).alias("displayed"))


@query("SELECT l_orderkey, max(l_shipdate) AS probed_at, arg_max(l_partkey, epoch_us(l_shipdate)::HUGEINT * 10000000 + l_partkey) AS size FROM lineitem GROUP BY 1")
def s14_latest_probe(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("probed_at"), F.max_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("size"))


@query("SELECT s.session_key, CASE WHEN n IS NULL THEN 'not_started' WHEN missing > 0 THEN 'inventory_complete_with_errors' ELSE 'inventory_complete' END AS inventory_status, CASE WHEN missing = 0 THEN latest END AS last_success FROM sess s LEFT JOIN (SELECT session_key, count(*) AS n, count(*) FILTER (source_presence = 'missing' AND bill_id % 5 = 0) AS missing, max(source_modified_at) AS latest FROM bill WHERE session_key <> '2001R1' GROUP BY 1) b ON b.session_key = s.session_key")
def s16_session_state(t: Tables) -> DataFrame:
    done = t.bill.where("session_key <> '2001R1'").groupBy("session_key").agg(F.count_if((C("source_presence") == "missing") & (C("bill_id") % 5 == 0)).alias("missing"), F.max("source_modified_at").alias("latest"))
    status = F.when(C("missing").isNull(), "not_started").otherwise(rollups.completeness(F.lit(False), C("missing") > 0))
    return t.sess.join(done, "session_key", "left").select("session_key", status.alias("inventory_status"), F.when(C("missing") == 0, C("latest")).alias("last_success"))


@query("SELECT b.k, 'v' AS \"column\", b.v AS old, a.v AS new FROM before b JOIN after a ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def s17_drift(t: Tables) -> DataFrame:
    return merge.drift(t.before, t.after, "k", ["v", "d"])


@query("""WITH c AS (SELECT bill_id, arg_min(CASE WHEN document_kind = 'unknown' THEN 'unknown_committee_document' ELSE 'committee_presentation' END, downloaded_bytes * 10 + source_id) AS r FROM doc WHERE document_kind IN ('committee_presentation', 'unknown') GROUP BY 1)
SELECT bill_id, reasons FROM (SELECT b.bill_id, list_filter([CASE WHEN b.bill_id IN (SELECT bill_id FROM doc WHERE document_kind = 'public_testimony') THEN 'public_testimony' END, c.r, CASE WHEN b.bill_id IN (SELECT bill_id FROM doc WHERE source_id = 3 AND bill_id % 2 = 0) THEN 'public_hearing_agenda' END], lambda x: x IS NOT NULL) AS reasons FROM bill b LEFT JOIN c ON c.bill_id = b.bill_id) WHERE len(reasons) > 0""")
def s18_candidates(t: Tables) -> DataFrame:
    docs = t.doc
    agenda = docs.where("source_id = 3").select("bill_id", F.when(C("bill_id") % 2 == 0, " Public  HEARING ").otherwise("Work Session").alias("meeting_type"))
    committee = docs.select("bill_id", (C("downloaded_bytes") * 10 + C("source_id")).alias("row_id"), C("document_kind").alias("kind")).where("kind in ('committee_presentation', 'unknown')")
    return reconcile.candidates(t.bill, docs.where("document_kind = 'public_testimony'"), committee, agenda)


@query("""WITH ch AS (SELECT l_orderkey AS bill_id, CASE WHEN l_returnflag = 'A' THEN 'testimony' ELSE 'committee' END AS family, max(l_shipdate) AS checked_at, bool_and(l_partkey % 9 > 0) AS ok FROM lineitem GROUP BY 1, 2),
f AS (SELECT bill_id, min(checked_at) AS c FROM ch GROUP BY 1 HAVING count(*) = 2 AND bool_and(ok)) SELECT f.bill_id FROM f LEFT JOIN bill b ON b.bill_id = f.bill_id WHERE b.source_modified_at IS NULL OR b.source_modified_at <= c""")
def s19_reusable(t: Tables) -> DataFrame:
    checks = t.lineitem.groupBy(C("l_orderkey").alias("bill_id"), F.when(C("l_returnflag") == "A", "testimony").otherwise("committee").alias("family")).agg(F.max("l_shipdate").alias("checked_at"), F.bool_and(C("l_partkey") % 9 > 0).alias("ok"))
    checks = checks.withColumn("status", F.when(C("ok"), "checked_zero").otherwise("failed_fetch"))
    return reconcile.reusable(checks, t.bill.select("bill_id", C("source_modified_at").alias("changed_at")))


@query("SELECT session_key, count(*) AS n FROM (SELECT DISTINCT doc_key, session_key FROM doc d JOIN bill b ON d.bill_id = b.bill_id WHERE download_status IN ('failed_retryable', 'failed_terminal') AND document_kind IN ('public_testimony', 'committee_presentation', 'floor_letter') AND trim(coalesce(canonical_download_url, '')) <> '' AND d.bill_id IN (SELECT item_key FROM item WHERE status LIKE 'failed%')) GROUP BY 1")
def s21_retry_snapshot(t: Tables) -> DataFrame:
    found = filters.retry_eligible(t.doc, t.bill, 1990, include_terminal=True).join(t.item.where("status like 'failed%'"), C("bill_id") == C("item_key"), "left_semi")
    return found.select("doc_key", "session_key").distinct().groupBy("session_key").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT doc_key, session_key FROM doc d JOIN bill b ON d.bill_id = b.bill_id WHERE d.source_presence = 'active' AND first_seen_at <= TIMESTAMP '1998-01-01' AND document_kind IN ('public_testimony', 'committee_presentation', 'floor_letter') AND download_status IN ('discovered', 'queued', 'failed_retryable', 'changed_remote') AND trim(coalesce(canonical_download_url, '')) <> '' AND d.bill_id NOT IN (SELECT item_key FROM item)")
def s22_work_list(t: Tables) -> DataFrame:
    fit = filters.download_candidates(t.doc).where(C("download_status").isin(filters.RETRYABLE) & (C("source_presence") == "active") & (C("first_seen_at") <= F.lit("1998-01-01").cast("timestamp")))
    return fit.join(t.item, C("bill_id") == C("item_key"), "left_anti").join(t.bill.select("bill_id", "session_key"), "bill_id").select("doc_key", "session_key").distinct()


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN session_key < '1996R1' THEN 'session_outside_scope' WHEN d.source_presence <> 'active' THEN 'presence_outside_scope' WHEN first_seen_at > TIMESTAMP '1998-01-01' THEN 'first_seen_after_cutoff' WHEN document_kind NOT IN ('public_testimony', 'committee_presentation', 'floor_letter') THEN 'kind_not_selected' WHEN trim(coalesce(canonical_download_url, '')) = '' THEN 'blank_url' WHEN download_status NOT IN ('discovered', 'queued', 'failed_retryable', 'changed_remote') THEN 'status_not_resumable' END AS reason FROM doc d JOIN bill b ON d.bill_id = b.bill_id) GROUP BY 1""")
def s23_scope_exit(t: Tables) -> DataFrame:
    both = t.doc.join(t.bill.select("bill_id", "session_key"), "bill_id")
    reason = reconcile.scope_exit(C("session_key") >= "1996R1", C("source_presence"), C("first_seen_at"), F.lit("1998-01-01").cast("timestamp"), C("document_kind").isin(filters.PAYLOAD_KINDS), X.blank(C("canonical_download_url")), C("download_status").isin(filters.RETRYABLE))
    return both.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT state, count(*) AS n, CAST(sum(downloaded_bytes) AS BIGINT) AS bytes FROM (SELECT downloaded_bytes, CASE WHEN ok AND NOT ch THEN 'valid' WHEN trim(coalesce(canonical_download_url, '')) = '' THEN 'failed_terminal' WHEN ch THEN 'changed_remote' ELSE 'missing_local' END AS state FROM (SELECT d.*, coalesce(content_length = downloaded_bytes, false) AS ok, d.bill_id % 6 = 0 AS ch FROM doc d LEFT JOIN (SELECT doc_key, max(content_length) AS content_length FROM probe GROUP BY 1) p ON p.doc_key = d.doc_key WHERE download_status = 'downloaded')) GROUP BY 1""")
def s24_payload_audit(t: Tables) -> DataFrame:
    files = t.probe.groupBy("doc_key").agg(F.max("content_length").alias("content_length"))
    rows = t.doc.where("download_status = 'downloaded'").join(files, "doc_key", "left")
    state = reconcile.payload_state(C("download_status"), C("bill_id") % 6 == 0, F.coalesce(C("content_length") == C("downloaded_bytes"), F.lit(False)), X.blank(C("canonical_download_url")))
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum("downloaded_bytes").alias("bytes"))


@query("SELECT session_key, measure_prefix, CASE WHEN measure_prefix IN ('HB', 'SB') THEN max(source_modified_at) END AS cursor, bool_and(measure_prefix IN ('HB', 'SB')) AS complete FROM bill GROUP BY 1, 2")
def s25_scope_invalidation(t: Tables) -> DataFrame:
    covered = C("measure_prefix").isin("HB", "SB")  # what the old scope held; the rest is to be read in full
    return t.bill.groupBy("session_key", "measure_prefix").agg(F.max(F.when(covered, C("source_modified_at"))).alias("cursor"), F.bool_and(covered).alias("complete"))


@query("SELECT b.bill_id, CASE WHEN b.source_presence = 'unknown' OR EXISTS (SELECT 1 FROM doc d WHERE d.bill_id = b.bill_id AND document_kind = 'public_testimony') THEN 'testimony' ELSE 'committee_documents' END AS family FROM bill b")
def s26_family(t: Tables) -> DataFrame:
    said = t.doc.where("document_kind = 'public_testimony'").select(C("bill_id").alias("b")).distinct()
    return t.bill.join(said, C("bill_id") == C("b"), "left").select("bill_id", F.when((C("source_presence") == "unknown") | C("b").isNotNull(), "testimony").otherwise("committee_documents").alias("family"))


@query("SELECT item_key, CASE WHEN status = 'failed_terminal' THEN 'preserved_terminal' WHEN status LIKE 'failed%' THEN 'retryable' WHEN status = 'skipped' THEN 'skipped_valid' ELSE status END AS result FROM item")
def s27_download_results(t: Tables) -> DataFrame:
    s = C("status")
    return t.item.select("item_key", F.when(s == "failed_terminal", "preserved_terminal").when(s.startswith("failed"), "retryable").when(s == "skipped", "skipped_valid").otherwise(s).alias("result"))


@query("SELECT concat(source, lang) AS document, sha256(text) AS sha256, min(doc_id) AS first_seen, count(*) AS n FROM documents GROUP BY 1, 2")
def s15_immutable_versions(t: Tables) -> DataFrame:
    rows = t.documents.select(F.concat("source", "lang").alias("document"), F.sha2("text", 256).alias("sha256"), "doc_id")
    return rows.groupBy("document", "sha256").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("n"))


@query("SELECT 'known status' AS rule, count(*) FILTER (download_status NOT IN ('discovered', 'queued', 'downloaded')) AS violations FROM doc UNION ALL SELECT 'no blank url', count(*) FILTER (trim(canonical_download_url) = '') FROM doc UNION ALL SELECT 'bytes are positive', count(*) FILTER (downloaded_bytes <= 0) FROM doc UNION ALL SELECT 'displayed is current', count(*) FILTER (displayed AND source_presence = 'missing') FROM doc")
def m1_constraints(t: Tables) -> DataFrame:
    return quality.constraint_audit(t.doc, {"known status": C("download_status").isin("discovered", "queued", "downloaded"), "no blank url": F.trim("canonical_download_url") != "", "bytes are positive": C("downloaded_bytes") > 0, "displayed is current": ~(C("displayed") & (C("source_presence") == "missing"))})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 HAVING count(*) > 1")
def m2_uniqueness(t: Tables) -> DataFrame:
    return quality.uniqueness_audit(t.lineitem, ["l_orderkey", "l_linenumber"], C("l_returnflag") != "N")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def m3_orphans(t: Tables) -> DataFrame:
    return quality.orphan_audit(t.orders, t.customer.where("c_custkey % 4 <> 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT i.run_id, count(*) AS n FROM item i JOIN bill b ON i.item_key = b.bill_id JOIN sess s ON s.session_key = b.session_key WHERE s.begin_date < (SELECT begin_date FROM sess WHERE session_key = '1997R1') GROUP BY 1")
def m4_boundary_guard(t: Tables) -> DataFrame:
    boundary = t.sess.where("session_key = '1997R1'").select(C("begin_date").alias("boundary")).limit(1)
    early = t.sess.crossJoin(F.broadcast(boundary)).where("begin_date < boundary").select("session_key")
    return t.item.join(t.bill, C("item_key") == C("bill_id")).join(early, "session_key").groupBy("run_id").agg(F.count("*").alias("n"))


@query("SELECT b.k FROM before b JOIN after a ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def m5_identity_mismatch(t: Tables) -> DataFrame:
    asked = t.before.select("k", C("v").alias("asked"))
    return asked.join(t.after, "k").where(~C("asked").eqNullSafe(C("v"))).select("k")


@query("SELECT c_custkey, sha256(concat_ws(chr(31), c_name, CAST(c_nationkey AS VARCHAR), '')) AS fingerprint FROM customer")
def m6_fingerprint(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.fingerprint([C("c_name"), C("c_nationkey"), F.lit(None).cast("string")]).alias("fingerprint"))
