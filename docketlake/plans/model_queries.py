"""Queries of joins, aggregates, windows, paging, set operations and read-models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions import text as X
from docketlake.operators import filters, paging, ranking, rollups
from docketlake.plans.registry import query
from docketlake.plans.standins import Tables

C = F.col
n_ = lambda: F.count("*").alias("n")


@query("SELECT d.doc_key, d.document_kind, b.session_key, p.content_length FROM doc d JOIN bill b ON d.bill_id = b.bill_id LEFT JOIN probe p ON d.doc_key = p.doc_key")
def d1_documents_bills_probes(t: Tables) -> DataFrame:
    return t.doc.join(t.bill.select("bill_id", "session_key"), "bill_id").join(t.probe, "doc_key", "left").select("doc_key", "document_kind", "session_key", "content_length")


@query("SELECT i.item_key, i.run_id, coalesce(d.bill_id, CASE WHEN i.item_key % 2 = 0 THEN i.item_key END) AS bill_id, b.session_key FROM item i LEFT JOIN (SELECT bill_id, min(doc_key) AS doc_key FROM doc GROUP BY 1) d ON i.item_key = d.bill_id LEFT JOIN bill b ON b.bill_id = coalesce(d.bill_id, CASE WHEN i.item_key % 2 = 0 THEN i.item_key END)")
def d2_items(t: Tables) -> DataFrame:
    docs = t.doc.groupBy(C("bill_id").alias("doc_bill")).agg(F.min("doc_key"))
    items = t.item.join(docs, C("item_key") == C("doc_bill"), "left").withColumn("key", F.coalesce("doc_bill", F.when(C("item_key") % 2 == 0, C("item_key"))))
    return items.join(t.bill.select(C("bill_id").alias("b"), "session_key"), C("key") == C("b"), "left").select("item_key", "run_id", C("key").alias("bill_id"), "session_key")


@query("SELECT e.id, e.retryable, d.n FROM err e LEFT JOIN (SELECT bill_id, count(*) AS n FROM doc GROUP BY 1) d ON e.id = d.bill_id")
def d3_errors_documents(t: Tables) -> DataFrame:
    return t.err.join(t.doc.groupBy("bill_id").agg(n_()), C("id") == C("bill_id"), "left").select("id", "retryable", "n")


@query("SELECT a.id, a.affects_completeness, d.n FROM anom a LEFT JOIN (SELECT bill_id, count(*) AS n FROM doc GROUP BY 1) d ON a.id = d.bill_id")
def d4_anomalies_documents(t: Tables) -> DataFrame:
    return t.anom.join(t.doc.groupBy("bill_id").agg(n_()), C("id") == C("bill_id"), "left").select("id", "affects_completeness", "n")


@query("SELECT s.session_key, n FROM sess s LEFT JOIN (SELECT session_key, count(*) AS n FROM bill GROUP BY 1) b ON s.session_key = b.session_key WHERE s.begin_date >= (SELECT begin_date FROM sess WHERE session_key = '1997R1')")
def d5_boundary(t: Tables) -> DataFrame:
    boundary = t.sess.where("session_key = '1997R1'").select(C("begin_date").alias("boundary")).limit(1)  # no row, no result
    return t.sess.join(t.bill.groupBy("session_key").agg(n_()), "session_key", "left").crossJoin(F.broadcast(boundary)).where("begin_date >= boundary").select("session_key", "n")


@query("SELECT bill_id FROM bill WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = sponsor_code AND c_mktsegment = 'BUILDING')")
def d6_semi(t: Tables) -> DataFrame:
    return t.bill.join(t.customer.where("c_mktsegment = 'BUILDING'"), C("sponsor_code") == C("c_custkey"), "left_semi").select("bill_id")


@query("SELECT DISTINCT doc_key FROM doc d WHERE trim(coalesce(canonical_download_url, '')) <> '' AND NOT EXISTS (SELECT 1 FROM probe p WHERE p.doc_key = d.doc_key AND p.content_length IS NOT NULL)")
def d7_anti(t: Tables) -> DataFrame:
    known = t.probe.where("content_length is not null")
    return t.doc.where(~X.blank(C("canonical_download_url"))).join(known, "doc_key", "left_anti").select("doc_key").distinct()


@query("SELECT b.bill_id, c.c_name AS sponsor, n.n_name AS committee FROM bill b LEFT JOIN customer c ON b.sponsor_code = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def d11_enrichment(t: Tables) -> DataFrame:
    names = t.customer.select(C("c_custkey").alias("sponsor_code"), C("c_name").alias("sponsor"), "c_nationkey")
    return t.bill.join(names, "sponsor_code", "left").join(t.nation, C("c_nationkey") == C("n_nationkey"), "left").select("bill_id", "sponsor", C("n_name").alias("committee"))


@query("SELECT count(*) AS children, count(*) FILTER (b.bill_id IS NULL) AS orphans FROM doc d LEFT JOIN (SELECT * FROM bill WHERE bill_id % 10 <> 3) b ON d.bill_id = b.bill_id")
def d12_parents(t: Tables) -> DataFrame:
    parents = t.bill.where("bill_id % 10 <> 3").select("bill_id")
    orphans = t.doc.join(parents, "bill_id", "left_anti").agg(F.count("*").alias("orphans"))
    return rollups.one_row([t.doc.agg(F.count("*").alias("children")), orphans])


@query("SELECT d.bill_id, d.source_id, i.ts FROM (SELECT DISTINCT bill_id, source_id FROM doc) d LEFT JOIN item i ON d.bill_id = i.item_key")
def d13_agenda(t: Tables) -> DataFrame:
    return t.doc.select("bill_id", "source_id").distinct().join(t.item, C("bill_id") == C("item_key"), "left").select("bill_id", "source_id", "ts")


@query("SELECT d.doc_key, i.status, p.content_length FROM doc d LEFT JOIN item i ON d.bill_id = i.item_key AND i.status <> 'completed' LEFT JOIN probe p ON d.doc_key = p.doc_key WHERE d.download_status = 'downloaded'")
def d14_audit_input(t: Tables) -> DataFrame:
    open_ = t.item.where("status <> 'completed'").select("item_key", "status")
    return t.doc.where("download_status = 'downloaded'").join(open_, C("bill_id") == C("item_key"), "left").join(t.probe, "doc_key", "left").select("doc_key", "status", "content_length")


@query("SELECT s.session_key, n FROM sess s JOIN (SELECT session_key, count(*) AS n FROM bill WHERE source_presence = 'missing' GROUP BY 1) b ON s.session_key = b.session_key")
def d15_inventoried_scope(t: Tables) -> DataFrame:
    return t.sess.join(t.bill.where("source_presence = 'missing'").groupBy("session_key").agg(n_()), "session_key").select("session_key", "n")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber + 1 AND m.l_returnflag = 'A')")
def d16_composite_semi(t: Tables) -> DataFrame:
    following = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", (C("l_linenumber") - 1).alias("l_linenumber"))
    return t.lineitem.join(following, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber").distinct()


@query("SELECT i.item_key, coalesce(b.session_key, c.c_mktsegment, concat('run ', i.run_id)) AS session_key FROM item i LEFT JOIN (SELECT * FROM bill WHERE bill_id % 3 = 0) b ON b.bill_id = i.item_key LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = i.item_key")
def d17_backfill(t: Tables) -> DataFrame:
    bills = t.bill.where("bill_id % 3 = 0").select("bill_id", "session_key")
    joined = t.item.join(bills, C("item_key") == C("bill_id"), "left").join(t.customer.where("c_custkey % 2 = 0"), C("item_key") == C("c_custkey"), "left")
    return joined.select("item_key", F.coalesce("session_key", "c_mktsegment", F.concat(F.lit("run "), C("run_id"))).alias("session_key"))


@query("SELECT DISTINCT i.run_id, b.session_key FROM item i JOIN doc d ON i.item_key = d.bill_id JOIN bill b ON d.bill_id = b.bill_id")
def d18_provenance(t: Tables) -> DataFrame:
    return t.item.join(t.doc.select("bill_id").distinct(), C("item_key") == C("bill_id"), "left_semi").join(t.bill, C("item_key") == C("bill_id")).select("run_id", "session_key").distinct()


_E1 = """
WITH lens AS (SELECT doc_key, max(content_length) AS content_length FROM probe GROUP BY 1),
placed AS (SELECT d.*, b.session_key, l.content_length, d.source_presence <> 'missing' AS cur, d.source_presence <> 'missing' AND trim(coalesce(canonical_download_url, '')) <> '' AND download_status <> 'not_applicable' AS dl FROM doc d JOIN bill b ON d.bill_id = b.bill_id LEFT JOIN lens l ON l.doc_key = d.doc_key),
m AS (SELECT session_key, count(*) FILTER (measure_prefix = 'HB') AS hb_count, count(*) FILTER (measure_prefix = 'SB') AS sb_count, count(*) FILTER (bill_chamber = 'House') AS house_measure_count, count(*) FILTER (bill_chamber = 'Senate') AS senate_measure_count FROM bill WHERE source_presence <> 'missing' GROUP BY 1),
f AS (SELECT session_key, count(*) FILTER (cur AND document_kind = 'public_testimony') AS public_testimony_count, count(*) FILTER (cur AND document_kind = 'committee_presentation') AS presentation_legacy_count, count(*) FILTER (cur AND document_kind = 'floor_letter') AS floor_letter_count, count(*) FILTER (cur) AS document_count,
  count(*) FILTER (dl) AS downloadable_count, count(*) FILTER (cur AND download_status = 'downloaded') AS downloaded_count, count(*) FILTER (cur AND download_status LIKE 'failed%') AS failure_count, count(*) FILTER (cur AND document_kind = 'unknown') AS unknown_count,
  CAST(coalesce(sum(content_length) FILTER (cur), 0) AS BIGINT) AS known_remote_bytes, count(*) FILTER (cur AND content_length IS NOT NULL) AS known_size_count, count(*) FILTER (dl AND content_length IS NULL) AS unknown_size_count, CAST(coalesce(sum(downloaded_bytes) FILTER (download_status = 'downloaded'), 0) AS BIGINT) AS local_archive_bytes FROM placed GROUP BY 1)
SELECT {} FROM (SELECT s.session_key, s.begin_date, m.* EXCLUDE (session_key), f.* EXCLUDE (session_key) FROM sess s LEFT JOIN m ON s.session_key = m.session_key LEFT JOIN f ON s.session_key = f.session_key)"""


@query(_E1.format("*"))
def e1_session_status(t: Tables) -> DataFrame:
    return rollups.session_status(t.sess, t.bill, t.doc, t.probe)


@query(_E1.format("session_key, document_count, downloaded_count, known_remote_bytes, unknown_size_count > 0 AS is_lower_bound"))
def e2_session_export(t: Tables) -> DataFrame:
    return rollups.session_status(t.sess, t.bill, t.doc, t.probe).select("session_key", "document_count", "downloaded_count", "known_remote_bytes", (C("unknown_size_count") > 0).alias("is_lower_bound"))


@query("SELECT (SELECT count(*) FROM sess) AS sessions, (SELECT count(*) FROM bill) AS bills, (SELECT count(*) FROM doc) AS documents, (SELECT count(*) FROM doc WHERE download_status = 'downloaded') AS downloaded, (SELECT CAST(sum(downloaded_bytes) AS BIGINT) FROM doc WHERE download_status = 'downloaded') AS bytes, (SELECT count(*) FROM err WHERE resolved_at IS NULL) AS open_errors, (SELECT count(*) FROM anom WHERE resolved_at IS NULL) AS open_anomalies, (SELECT count(DISTINCT run_id) FROM item) AS runs")
def e3_dashboard(t: Tables) -> DataFrame:
    done = C("download_status") == "downloaded"
    return rollups.one_row([
        t.sess.agg(F.count("*").alias("sessions")),
        t.bill.agg(F.count("*").alias("bills")),
        t.doc.agg(F.count("*").alias("documents"), F.count_if(done).alias("downloaded"), F.sum(F.when(done, C("downloaded_bytes"))).alias("bytes")),
        filters.open_rows(t.err).agg(F.count("*").alias("open_errors")),
        filters.open_rows(t.anom).agg(F.count("*").alias("open_anomalies")),
        t.item.agg(F.countDistinct("run_id").alias("runs")),
    ])


@query("SELECT run_id, count(*) AS recorded, count(*) FILTER (status = 'completed') AS downloaded, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status LIKE 'failed%') AS failed, count(*) FILTER (status <> 'queued') AS current_items FROM item GROUP BY 1")
def e4_run_items(t: Tables) -> DataFrame:
    s = C("status")
    return t.item.groupBy("run_id").agg(F.count("*").alias("recorded"), F.count_if(s == "completed").alias("downloaded"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s.startswith("failed")).alias("failed"), F.count_if(s != "queued").alias("current_items"))


@query("SELECT l_orderkey, string_agg(l_returnflag, ', ' ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN 2147483647 ELSE l_linenumber END, l_partkey, l_suppkey) AS flags FROM lineitem WHERE trim(l_returnflag) <> '' GROUP BY 1")
def e5_ordered_names(t: Tables) -> DataFrame:
    order = F.coalesce(F.when(C("l_linenumber") % 2 != 0, C("l_linenumber")), F.lit(2147483647))
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), "l_partkey", "l_suppkey", "l_returnflag")))
    return t.lineitem.where(~X.blank(C("l_returnflag"))).groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_returnflag"]), ", ").alias("flags"))


@query("SELECT b.bill_id, coalesce(d.n, 0) AS documents, s.sponsors FROM bill b LEFT JOIN (SELECT bill_id, count(DISTINCT doc_key) AS n FROM doc GROUP BY 1) d ON d.bill_id = b.bill_id LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sponsors FROM lineitem GROUP BY 1) s ON s.l_orderkey = b.bill_id")
def e6_two_sided(t: Tables) -> DataFrame:
    docs = t.doc.groupBy("bill_id").agg(F.countDistinct("doc_key").alias("n"))
    names = t.lineitem.groupBy(C("l_orderkey").alias("bill_id")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("sponsors"))
    return t.bill.join(docs, "bill_id", "left").join(names, "bill_id", "left").select("bill_id", F.coalesce("n", F.lit(0)).alias("documents"), "sponsors")


@query("SELECT run_id, count(*) AS total, count(*) FILTER (affects_completeness) AS material FROM anom WHERE resolved_at IS NULL GROUP BY 1")
def e7_anomaly_counts(t: Tables) -> DataFrame:
    return filters.open_rows(t.anom).groupBy("run_id").agg(F.count("*").alias("total"), F.count_if("affects_completeness").alias("material"))


@query("SELECT b.session_key, count(DISTINCT b.bill_id) AS bills, count(d.doc_key) AS documents FROM bill b LEFT JOIN (SELECT * FROM doc WHERE source_presence <> 'missing') d ON d.bill_id = b.bill_id WHERE b.source_presence <> 'missing' GROUP BY 1")
def e8_current_counts(t: Tables) -> DataFrame:
    docs = t.doc.where("source_presence <> 'missing'").groupBy("bill_id").agg(n_())
    return t.bill.where("source_presence <> 'missing'").join(docs, "bill_id", "left").groupBy("session_key").agg(F.count("*").alias("bills"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


@query("SELECT b.session_key, max(greatest(source_modified_at, coalesce(first_seen_at, source_modified_at))) AS watermark FROM bill b LEFT JOIN (SELECT bill_id, max(first_seen_at) AS first_seen_at FROM doc GROUP BY 1) d ON d.bill_id = b.bill_id GROUP BY 1")
def e9_watermark(t: Tables) -> DataFrame:
    seen = t.doc.groupBy("bill_id").agg(F.max("first_seen_at").alias("first_seen_at"))
    return t.bill.join(seen, "bill_id", "left").groupBy("session_key").agg(F.max(F.greatest("source_modified_at", "first_seen_at")).alias("watermark"))


@query("SELECT user_id, arg_max(raw, o) AS cursor_text FROM (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS raw, CAST(epoch_us(ts) AS HUGEINT) * 1000000 - event_id AS o FROM events) GROUP BY 1")
def e10_cursor_text(t: Tables) -> DataFrame:
    raw = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.events.groupBy("user_id").agg(F.max_by(raw, F.struct("ts", -C("event_id"))).alias("cursor_text"))


@query("""WITH lens AS (SELECT doc_key, max(content_length) AS content_length FROM probe GROUP BY 1), s AS (SELECT d.*, content_length, trim(coalesce(canonical_download_url, '')) <> '' AS u, trim(coalesce(canonical_download_url, '')) <> '' AND download_status IN ('discovered', 'queued', 'failed_retryable', 'changed_remote') AS todo FROM doc d LEFT JOIN lens l ON l.doc_key = d.doc_key WHERE document_kind IN ('public_testimony', 'committee_presentation', 'floor_letter'))
SELECT count(*) AS in_scope, count(*) FILTER (download_status = 'downloaded') AS downloaded, count(*) FILTER (u AND download_status IN ('discovered', 'queued')) AS pending, count(*) FILTER (u AND download_status IN ('failed_retryable', 'changed_remote')) AS retryable, count(*) FILTER (NOT u OR download_status IN ('failed_terminal', 'not_applicable')) AS terminal, CAST(coalesce(sum(content_length) FILTER (todo), 0) AS BIGINT) AS known_bytes, count(*) FILTER (todo AND content_length IS NULL) AS unknown_sizes, bool_or(todo AND content_length IS NULL) AS is_lower_bound FROM s""")
def e11_preflight(t: Tables) -> DataFrame:
    return rollups.preflight(t.doc, t.probe)


@query("SELECT CASE WHEN s.id IS NULL THEN 'page_only' WHEN p.id IS NULL THEN 'source_only' ELSE 'matched' END AS side, count(*) AS n FROM source_side s FULL JOIN page_side p ON s.id = p.id GROUP BY 1")
def e13_reconciliation_counts(t: Tables) -> DataFrame:
    both = t.source_side.select(C("id").alias("s")).join(t.page_side.select(C("id").alias("p")), C("s") == C("p"), "full_outer")
    return both.select(F.when(C("s").isNull(), "page_only").when(C("p").isNull(), "source_only").otherwise("matched").alias("side")).groupBy("side").agg(n_())


@query("SELECT session_key, CASE min(r) WHEN 0 THEN 'failed_fetch' WHEN 1 THEN 'parser_anomalous' WHEN 2 THEN 'checked_with_records' WHEN 3 THEN 'checked_zero' ELSE 'not_applicable' END AS display_status FROM (SELECT session_key, CASE WHEN CAST(substr(session_key, 1, 4) AS INT) % 4 = 0 THEN 4 WHEN source_presence = 'missing' AND CAST(substr(session_key, 1, 4) AS INT) % 4 = 1 THEN 0 WHEN source_presence = 'unknown' AND CAST(substr(session_key, 1, 4) AS INT) % 4 = 2 THEN 1 ELSE CAST(bill_id % 2 AS INT) + 2 END AS r FROM bill) GROUP BY 1")
def e14_display_status(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ["failed_fetch", "parser_anomalous", "checked_with_records", "checked_zero", "not_applicable"]))
    year = F.substring("session_key", 1, 4).cast("int") % 4
    rank = F.when(year == 0, 4).when((C("source_presence") == "missing") & (year == 1), 0).when((C("source_presence") == "unknown") & (year == 2), 1).otherwise((C("bill_id") % 2).cast("int") + 2)
    ranked = t.bill.select("session_key", rank.alias("r"))
    return ranked.groupBy("session_key").agg(F.min("r").alias("r")).select("session_key", F.element_at(names, C("r") + 1).alias("display_status"))


@query("SELECT run_id, count(*) AS open_errors FROM err WHERE resolved_at IS NULL GROUP BY 1")
def e15_open_errors(t: Tables) -> DataFrame:
    return filters.open_rows(t.err).groupBy("run_id").agg(F.count("*").alias("open_errors"))


@query("SELECT i.run_id, CASE WHEN done = 0 AND fatal > 0 THEN 'failed' WHEN failed > 0 OR coalesce(o, 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS outcome FROM (SELECT run_id, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed_terminal') AS fatal, count(*) FILTER (status LIKE 'failed%') AS failed FROM item GROUP BY 1) i LEFT JOIN (SELECT run_id, count(*) AS o FROM err WHERE resolved_at IS NULL GROUP BY 1) e ON e.run_id = i.run_id")
def e16_run_outcome(t: Tables) -> DataFrame:
    return rollups.run_outcome(t.item, t.err)


@query("SELECT i.run_id, CASE WHEN done = 0 AND fatal > 0 THEN 'failed' WHEN failed > 0 OR coalesce(o, 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS outcome FROM (SELECT run_id, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed_terminal') AS fatal, count(*) FILTER (status LIKE 'failed%') AS failed FROM item GROUP BY 1) i LEFT JOIN (SELECT run_id, count(*) AS o FROM err WHERE resolved_at IS NULL GROUP BY 1) e ON e.run_id = i.run_id")
def e16_run_outcome_whole(t: Tables) -> DataFrame:
    return rollups.run_outcome(t.item, t.err)


@query("SELECT b.session_key, CASE WHEN bool_or(source_presence = 'missing' AND b.bill_id % 500 = 0) THEN 'inventory_incomplete' WHEN bool_or(source_presence = 'unknown' AND b.bill_id % 70 = 0) THEN 'inventory_complete_with_errors' ELSE 'inventory_complete' END AS status FROM bill b GROUP BY 1")
def e17_completeness(t: Tables) -> DataFrame:
    gap = F.bool_or((C("source_presence") == "missing") & (C("bill_id") % 500 == 0))
    return t.bill.groupBy("session_key").agg(rollups.completeness(gap, F.bool_or((C("source_presence") == "unknown") & (C("bill_id") % 70 == 0))).alias("status"))


@query("SELECT b.session_key, CASE WHEN bool_or(download_status = 'failed_retryable') THEN 'retryable' WHEN bool_or(download_status = 'failed_terminal') THEN 'terminal' ELSE 'completed' END AS outcome FROM doc d JOIN bill b ON d.bill_id = b.bill_id GROUP BY 1")
def e18_download_outcome(t: Tables) -> DataFrame:
    both = t.doc.join(t.bill.select("bill_id", "session_key"), "bill_id")
    return both.groupBy("session_key").agg(F.when(F.bool_or(C("download_status") == "failed_retryable"), "retryable").when(F.bool_or(C("download_status") == "failed_terminal"), "terminal").otherwise("completed").alias("outcome"))


@query("SELECT b.session_key, CASE WHEN bool_or(download_status = 'failed_retryable') THEN 'retryable' WHEN bool_or(download_status = 'failed_terminal') THEN 'terminal' ELSE 'completed' END AS outcome FROM doc d JOIN bill b ON d.bill_id = b.bill_id GROUP BY 1")
def e18_download_outcome_whole(t: Tables) -> DataFrame:
    both = t.doc.join(t.bill.select("bill_id", "session_key"), "bill_id")
    return both.groupBy("session_key").agg(F.when(F.bool_or(C("download_status") == "failed_retryable"), "retryable").when(F.bool_or(C("download_status") == "failed_terminal"), "terminal").otherwise("completed").alias("outcome"))


@query("SELECT run_id, count(*) AS total, count(*) FILTER (status <> 'queued') AS current, floor(100 * count(*) FILTER (status <> 'queued') / count(*)) AS percent FROM item GROUP BY 1")
def e19_progress(t: Tables) -> DataFrame:
    current = F.count_if(C("status") != "queued")
    return t.item.groupBy("run_id").agg(F.count("*").alias("total"), current.alias("current"), F.floor(100 * current / F.count("*")).cast("double").alias("percent"))


@query("SELECT document, doc_id AS version, sha FROM (SELECT concat(source, lang) AS document, doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def f1_latest_version(t: Tables) -> DataFrame:
    rows = t.documents.select(F.concat("source", "lang").alias("document"), C("doc_id").alias("version"), F.sha2("text", 256).alias("sha"))
    return ranking.latest(rows, ["document"], [C("version").desc()])


@query("""WITH v AS (SELECT concat(source, '/', lang) AS document, sha256(text) AS sha256, doc_id FROM documents), known AS (SELECT document, sha256, row_number() OVER (PARTITION BY document ORDER BY doc_id) AS version FROM v WHERE doc_id % 3 = 0),
tops AS (SELECT document, max(version) AS top FROM known GROUP BY 1), olds AS (SELECT document, sha256, min(version) AS old FROM known GROUP BY 1 , 2), new AS (SELECT document, sha256, min(doc_id) AS seen FROM v WHERE doc_id % 3 <> 0 GROUP BY 1, 2)
SELECT n.document, n.sha256, CAST(coalesce(old, coalesce(top, 0) + row_number() OVER (PARTITION BY n.document, old IS NULL ORDER BY seen)) AS BIGINT) AS version, old IS NULL AS is_new FROM new n LEFT JOIN olds o ON n.document = o.document AND n.sha256 = o.sha256 LEFT JOIN tops t ON n.document = t.document""")
def f2_next_versions(t: Tables) -> DataFrame:
    rows = t.documents.select(F.concat_ws("/", "source", "lang").alias("document"), F.sha2("text", 256).alias("sha256"), C("doc_id").alias("seen"))
    known = rows.where("seen % 3 = 0").withColumn("version", F.row_number().over(Window.partitionBy("document").orderBy("seen")))
    return ranking.next_versions(rows.where("seen % 3 <> 0"), known).withColumn("version", C("version").cast("bigint"))


@query("SELECT l_orderkey, l_linenumber, arg_min(l_suppkey, l_partkey * 1000000 + l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, count(*) AS n_rows, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY 1, 2")
def f3_first_wins(t: Tables) -> DataFrame:
    found = ranking.first_wins(t.lineitem.withColumn("o", C("l_partkey")), ["l_orderkey", "l_linenumber"], "o", ["l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", "l_suppkey", C("o").alias("l_partkey"), "n_rows", "conflict")


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def f4_last_wins(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_partkey", F.struct("l_partkey", "l_suppkey")).alias("l_partkey"))


@query("""SELECT user_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM (SELECT user_id, event_id, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, event_type IN ('error', 'signup', 'view') AS f FROM events)) WHERE f GROUP BY user_id, island HAVING count(*) >= 3""")
def f5_streaks(t: Tables) -> DataFrame:
    return ranking.streaks(t.events, "user_id", "event_id", C("event_type").isin("error", "signup", "view"), 3)


@query("SELECT l_orderkey AS bill_id, min(l_shipdate) AS oldest FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def f6_oldest_check(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag in ('A', 'R')").groupBy(C("l_orderkey").alias("bill_id")).agg(F.min("l_shipdate").alias("oldest"))


@query("SELECT session_key, CAST(row_number() OVER (ORDER BY begin_date, session_key) AS INT) AS ordinal FROM sess")
def f7_session_ordinal(t: Tables) -> DataFrame:
    # the scope is a short frozen list: positions of an array keep its order without a global window over rows
    frozen = t.sess.agg(F.sort_array(F.collect_list(F.struct("begin_date", "session_key"))).alias("scope"))
    return frozen.select(F.posexplode("scope").alias("p", "s")).select("s.session_key", (C("p") + 1).alias("ordinal"))


@query("SELECT bill_id, total FROM (SELECT bill_id, count(*) OVER () AS total, row_number() OVER (ORDER BY session_key NULLS FIRST, measure_prefix NULLS FIRST, CAST(measure_number AS BIGINT) DESC NULLS LAST, bill_id) AS r FROM bill WHERE session_key = '1996R1') WHERE r > 50 AND r <= 150")
def g1_page_with_total(t: Tables) -> DataFrame:
    found = filters.bill_search(t.bill, "1996R1")
    return paging.with_total(paging.page(found, paging.bill_order("bill", True), 100, 50), found).select("bill_id", "total")


@query("SELECT bill_id FROM (SELECT bill_id, row_number() OVER (ORDER BY bill_title DESC NULLS LAST, bill_id) AS r FROM bill) WHERE r <= 500")
def g2_sorts(t: Tables) -> DataFrame:
    return paging.page(t.bill, paging.bill_order("title", True), 10_000).select("bill_id")


@query("SELECT doc_key FROM (SELECT doc_key, row_number() OVER (ORDER BY session_key DESC NULLS LAST, d.bill_id, document_kind, coalesce(canonical_download_url, ''), doc_key) AS r FROM doc d JOIN bill b ON d.bill_id = b.bill_id) WHERE r <= 200")
def g3_document_order(t: Tables) -> DataFrame:
    both = t.doc.join(t.bill.select("bill_id", "session_key"), "bill_id")
    return paging.page(both, [C("session_key").desc_nulls_last(), C("bill_id"), C("document_kind"), F.coalesce("canonical_download_url", F.lit("")), C("doc_key")], 200).select("doc_key")


@query("SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END, s_suppkey) AS INT) AS place FROM supplier")
def g4_sponsor_order(t: Tables) -> DataFrame:
    rank = F.when(C("s_suppkey") % 3 == 0, 1).when(C("s_suppkey") % 3 == 1, 2).otherwise(0)
    return t.supplier.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(rank, "s_suppkey")).alias("place"))


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY last_occurred_at DESC NULLS LAST, id DESC) AS r FROM err) WHERE r <= 100")
def g6_recency(t: Tables) -> DataFrame:
    return paging.page(t.err, [C("last_occurred_at").desc_nulls_last(), C("id").desc()], 100).select("id")


@query("SELECT bill_id FROM bill WHERE bill_id > 5000 ORDER BY bill_id LIMIT 200")
def g7_keyset(t: Tables) -> DataFrame:
    return paging.keyset_page(t.bill.select("bill_id"), "bill_id", 5000, 200)


@query("SELECT bill_id, arg_min(document_kind, CASE WHEN document_kind LIKE '%testimony' THEN 0 ELSE 1 END * 1000 + length(document_kind)) AS kind FROM doc GROUP BY 1")
def g8_preference(t: Tables) -> DataFrame:
    rank = F.when(C("document_kind").endswith("testimony"), 0).otherwise(1)
    return t.doc.groupBy("bill_id").agg(F.min_by("document_kind", F.struct(rank, F.length("document_kind"))).alias("kind"))


_FEED = "SELECT 'error' AS view, id, run_id, last_occurred_at AS last_at, retryable, CAST(NULL AS BOOLEAN) AS affects_completeness FROM err WHERE resolved_at IS NULL UNION ALL SELECT 'anomaly', id, run_id, last_observed_at, CAST(NULL AS BOOLEAN), affects_completeness FROM anom WHERE resolved_at IS NULL AND affects_completeness"


@query(_FEED)
def h1_operations(t: Tables) -> DataFrame:
    errors = filters.open_rows(t.err).select(F.lit("error").alias("view"), "id", "run_id", C("last_occurred_at").alias("last_at"), "retryable")
    anomalies = filters.open_rows(t.anom).where("affects_completeness").select(F.lit("anomaly").alias("view"), "id", "run_id", C("last_observed_at").alias("last_at"), "affects_completeness")
    return errors.unionByName(anomalies, allowMissingColumns=True)


@query("""WITH d AS (SELECT 'source_only' AS finding, id FROM source_side WHERE id NOT IN (SELECT id FROM page_side) UNION ALL SELECT 'page_only', id FROM page_side WHERE id NOT IN (SELECT id FROM source_side))
SELECT * FROM d UNION ALL SELECT 'count_mismatch', CAST(NULL AS BIGINT) WHERE EXISTS (SELECT 1 FROM d)""")
def h2_discrepancies(t: Tables) -> DataFrame:
    source, page = t.source_side.select("id"), t.page_side.select("id")
    found = source.join(page, "id", "left_anti").select(F.lit("source_only").alias("finding"), "id").union(page.join(source, "id", "left_anti").select(F.lit("page_only"), "id"))
    return found.union(found.limit(1).select(F.lit("count_mismatch"), F.lit(None).cast("bigint")))


@query("SELECT bill_id FROM bill WHERE bill_id IN (SELECT item_key FROM item WHERE status = 'queued') OR bill_id IN (SELECT bill_id FROM doc WHERE displayed IS NULL AND source_id = 7) OR bill_id IN (SELECT id FROM err)")
def h3_staleness(t: Tables) -> DataFrame:
    reasons = t.item.where("status = 'queued'").select(C("item_key").alias("bill_id")).union(t.doc.where("displayed is null and source_id = 7").select("bill_id")).union(t.err.select("id"))
    return t.bill.join(reasons, "bill_id", "left_semi").select("bill_id")


@query("SELECT id, max(o) AS last_source FROM (SELECT id, 1 AS o FROM source_side UNION ALL SELECT id, 2 FROM page_side UNION ALL SELECT id, 3 FROM err UNION ALL SELECT id, 4 FROM anom) GROUP BY 1")
def h4_union_of_sources(t: Tables) -> DataFrame:
    frames = [f.select("id", F.lit(k).alias("o")) for k, f in enumerate((t.source_side, t.page_side, t.err, t.anom), 1)]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return every.groupBy("id").agg(F.max("o").alias("last_source"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def h5_required_minus_actual(t: Tables) -> DataFrame:
    actual = t.customer.where("c_custkey % 4 <> 0").select(C("c_custkey").alias("o_custkey"))
    return t.orders.select("o_custkey").distinct().join(actual, "o_custkey", "left_anti")


@query("SELECT k AS key, CAST(min(p) AS INT) AS place FROM (SELECT o_custkey % 50 AS k, o_orderkey AS p FROM orders) GROUP BY 1")
def h6_ordered_dedupe(t: Tables) -> DataFrame:
    return t.orders.groupBy((C("o_custkey") % 50).alias("key")).agg(F.min("o_orderkey").cast("int").alias("place"))


@query("SELECT bill_id, session_key, bill_title, flags FROM (SELECT b.*, f.flags, row_number() OVER (ORDER BY source_modified_at DESC NULLS LAST, b.bill_id) AS r FROM bill b LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1) f ON f.l_orderkey = b.bill_id WHERE bill_chamber = 'House' AND trim(coalesce(chapter_number, '')) = '') WHERE r <= 100")
def r1_bills(t: Tables) -> DataFrame:
    found = paging.page(filters.bill_search(t.bill, chamber="House", enacted_only=False), paging.bill_order("modified", True), 100)
    names = t.lineitem.groupBy(C("l_orderkey").alias("bill_id")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ", ").alias("flags"))
    return found.join(names, "bill_id", "left").select("bill_id", "session_key", "bill_title", "flags")


@query("SELECT doc_key, session_key, content_length, total FROM (SELECT d.doc_key, session_key, content_length, count(*) OVER () AS total, row_number() OVER (ORDER BY session_key DESC NULLS LAST, d.bill_id, document_kind, d.doc_key) AS r FROM doc d JOIN bill b ON d.bill_id = b.bill_id LEFT JOIN probe p ON p.doc_key = d.doc_key WHERE displayed AND download_status = 'downloaded') WHERE r <= 100")
def r2_documents(t: Tables) -> DataFrame:
    found = filters.document_search(t.doc, status="downloaded", displayed="yes").join(t.bill.select("bill_id", "session_key"), "bill_id").join(t.probe, "doc_key", "left")
    rows = paging.page(found, [C("session_key").desc_nulls_last(), C("bill_id"), C("document_kind"), C("doc_key")], 100)
    return paging.with_total(rows, found).select("doc_key", "session_key", "content_length", "total")


@query("SELECT i.run_id, n_items, n_failed, coalesce(open_errors, 0) AS open_errors FROM (SELECT run_id, count(*) AS n_items, count(*) FILTER (status LIKE 'failed%') AS n_failed FROM item GROUP BY 1) i LEFT JOIN (SELECT run_id, count(*) AS open_errors FROM err WHERE resolved_at IS NULL GROUP BY 1) e ON e.run_id = i.run_id")
def r3_runs(t: Tables) -> DataFrame:
    runs = t.item.groupBy("run_id").agg(F.count("*").alias("n_items"), F.count_if(C("status").startswith("failed")).alias("n_failed"))
    return runs.join(e15_open_errors(t), "run_id", "left").select("run_id", "n_items", "n_failed", F.coalesce("open_errors", F.lit(0)).alias("open_errors"))


@query("SELECT s.session_key, s.begin_date, coalesce(n, 0) AS bills, s.begin_date >= (SELECT begin_date FROM sess WHERE session_key = '1997R1') AS supported FROM sess s LEFT JOIN (SELECT session_key, count(*) AS n FROM bill GROUP BY 1) b ON b.session_key = s.session_key WHERE EXISTS (SELECT 1 FROM sess WHERE session_key = '1997R1')")
def r4_session_choices(t: Tables) -> DataFrame:
    boundary = t.sess.where("session_key = '1997R1'").select(C("begin_date").alias("boundary")).limit(1)
    return t.sess.join(t.bill.groupBy("session_key").agg(n_()), "session_key", "left").crossJoin(F.broadcast(boundary)).select("session_key", "begin_date", F.coalesce("n", F.lit(0)).alias("bills"), (C("begin_date") >= C("boundary")).alias("supported"))


@query(f"SELECT view, id, run_id, last_at FROM (SELECT *, row_number() OVER (ORDER BY last_at DESC, view, id DESC) AS r FROM ({_FEED})) WHERE r <= 100")
def r6_operations_page(t: Tables) -> DataFrame:
    return paging.page(h1_operations(t), [C("last_at").desc(), C("view"), C("id").desc()], 100).select("view", "id", "run_id", "last_at")


@query("SELECT d.doc_key, b.session_key, max(i.ts) AS last_attempt FROM doc d JOIN bill b ON d.bill_id = b.bill_id JOIN item i ON i.item_key = d.bill_id WHERE CAST(substr(session_key, 1, 4) AS INT) >= 1995 AND download_status IN ('failed_retryable', 'failed_terminal') AND document_kind IN ('public_testimony', 'committee_presentation', 'floor_letter') AND trim(coalesce(canonical_download_url, '')) <> '' GROUP BY 1, 2")
def r7_retry_documents(t: Tables) -> DataFrame:
    attempts = t.item.groupBy(C("item_key").alias("bill_id")).agg(F.max("ts").alias("last_attempt"))
    found = filters.retry_eligible(t.doc, t.bill, 1995, include_terminal=True).join(attempts, "bill_id")
    return found.groupBy("doc_key", "session_key").agg(F.max("last_attempt").alias("last_attempt"))


@query("SELECT d.bill_id, CASE WHEN document_kind IN ('public_testimony', 'legacy_testimony') THEN 'testimony' ELSE document_kind END AS section, count(*) AS n, max(first_seen_at) AS latest FROM doc d JOIN bill b ON d.bill_id = b.bill_id GROUP BY 1, 2")
def r9_bill_detail(t: Tables) -> DataFrame:
    section = F.when(C("document_kind").endswith("testimony"), "testimony").otherwise(C("document_kind"))
    return t.doc.join(t.bill.select("bill_id"), "bill_id").groupBy("bill_id", section.alias("section")).agg(n_(), F.max("first_seen_at").alias("latest"))
