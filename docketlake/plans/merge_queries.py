"""Queries of the merges, ledgers, states, frozen lists and versions with their full rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.operators import archive, filters, ledgers, merge, paging, quality
from docketlake.plans.registry import query
from docketlake.plans.standins import Tables

C = F.col
_NOW = "TIMESTAMP '2024-06-01 00:00:00'"
_now = lambda: F.lit("2024-06-01 00:00:00").cast("timestamp")

_IN = """i AS (SELECT *, concat(upper(measure_prefix), measure_number) AS own, CASE WHEN measure_number > 999999 OR (bill_id_compact IS NOT NULL AND upper(regexp_replace(bill_id_compact, '[ -]', '', 'g')) <> concat(upper(measure_prefix), measure_number)) THEN 'identity' WHEN trim(bill_chamber) = 'Joint' THEN 'chamber' WHEN measure_type = 'Petition' THEN 'type' END AS problem FROM inbill)"""


@query(f"WITH {_IN}, n AS (SELECT * FROM i WHERE problem IS NULL) SELECT coalesce(o.session_key, n.session_key) AS session_key, coalesce(o.bill_id_compact, own) AS bill_id_compact, coalesce(n.bill_title, o.bill_title) AS bill_title, CASE WHEN own IS NOT NULL THEN 'active' ELSE source_presence END AS source_presence, CASE WHEN own IS NULL THEN missing_since END AS missing_since, coalesce(first_collected_at, {_NOW}) AS first_collected_at FROM oldbill o FULL JOIN n ON o.session_key = n.session_key AND o.bill_id_compact = n.own")
def s7_merge_bills(t: Tables) -> DataFrame:
    return ledgers.merge_bills(t.oldbill, t.inbill, _now())[0]


@query(f"WITH {_IN} SELECT session_key, measure_number, problem FROM i WHERE problem IS NOT NULL")
def s7_rejected_bills(t: Tables) -> DataFrame:
    return ledgers.merge_bills(t.oldbill, t.inbill, _now())[1].select("session_key", "measure_number", "problem")


@query(f"WITH {_IN} SELECT o.session_key, o.bill_id_compact, 'reappeared' AS event, {_NOW} AS \"at\" FROM oldbill o JOIN i ON o.session_key = i.session_key AND o.bill_id_compact = i.own WHERE problem IS NULL AND source_presence = 'missing'")
def s7_return_events(t: Tables) -> DataFrame:
    return ledgers.merge_bills(t.oldbill, t.inbill, _now())[2]


_KINDS = {"session": ("session_key",), "legislator": ("session_key", "legislator_code"), "committee": ("session_key", "committee_code"), "sponsor": ("bill_id", "source_measure_sponsor_id"), "meeting": ("session_key", "source_meeting_id"), "agenda": ("session_key", "source_agenda_item_id")}


def _reference(t: Tables, kind: str) -> tuple[DataFrame, DataFrame]:
    """(target, source) of a reference table; sessions are one row a key, others one row a customer."""
    keys = _KINDS[kind]
    if kind == "session":
        rows = t.refs.groupBy("session_key").agg(F.min("k").alias("k"), F.min("name").alias("name"), F.min("seg").alias("seg"))
    else:
        rows = t.refs.withColumnRenamed("session_key", keys[0]).withColumn(keys[1], F.col("code"))
    target = rows.where("k % 3 <> 0 and k % 9 <> 0").select(*keys, C("name").alias("title"), C("k").alias("first_seen_at"))
    return target, rows.where("k % 4 <> 0").select(*keys, C("seg").alias("title"), (C("k") + 1000).alias("first_seen_at"))


_REF = """SELECT '{kind}' AS kind, coalesce(a.k1, b.k1) AS k1, coalesce(a.k2, b.k2) AS k2, coalesce(b.t, a.t) AS title, coalesce(a.s, b.s) AS first_seen_at FROM (SELECT k1, k2, name AS t, k AS s FROM {rows} WHERE k % 3 <> 0 AND k % 9 <> 0) a FULL JOIN (SELECT k1, k2, seg AS t, k + 1000 AS s FROM {rows} WHERE k % 4 <> 0 AND trim(coalesce(k2, 'x')) <> '') b ON a.k1 = b.k1 AND coalesce(a.k2, '') = coalesce(b.k2, '')"""
_ROWS = {k: "(SELECT session_key AS k1, code AS k2, k, name, seg FROM refs)" for k in _KINDS} | {"session": "(SELECT session_key AS k1, CAST(NULL AS VARCHAR) AS k2, min(k) AS k, min(name) AS name, min(seg) AS seg FROM refs GROUP BY 1)"}


@query(" UNION ALL ".join(_REF.format(kind=k, rows=_ROWS[k]) for k in _KINDS))
def s8_reference_merges(t: Tables) -> DataFrame:
    frames = []
    for kind, keys in _KINDS.items():
        merged = ledgers.merge_reference(kind, *_reference(t, kind))[0]
        second = C(keys[1]) if len(keys) > 1 else F.lit(None).cast("string")
        frames.append(merged.select(F.lit(kind).alias("kind"), C(keys[0]).alias("k1"), second.alias("k2"), "title", "first_seen_at"))
    return reduce(DataFrame.union, frames)


_FIND = """f AS (SELECT anomaly_type, upper(trim(coalesce(x.session_key, d.session_key, b.session_key))) AS session_key, coalesce(x.bill, d.bill, b.bill) AS bill, x.document_id, source_entity_type, source_id, previous_value, current_value, message, severity, run_id, at_, late FROM found x LEFT JOIN docid d ON d.document_id = x.document_id LEFT JOIN billid b ON b.bill_id = coalesce(x.bill_id, d.bill_id)),
k AS (SELECT *, sha256(concat_ws(chr(31), anomaly_type, coalesce(session_key, ''), coalesce(bill, ''), coalesce(CAST(document_id AS VARCHAR), ''), source_entity_type, source_id, coalesce(previous_value, ''), coalesce(current_value, ''), message)) AS fingerprint FROM f)"""
_GROUP = "SELECT fingerprint, min(at_) AS lo, max(at_) AS hi, count(*) AS n, arg_min(run_id, run_id) AS r1, arg_max(run_id, run_id) AS r2, arg_max(severity, run_id) AS severity, any_value(session_key) AS session_key, any_value(bill) AS bill FROM k WHERE {} GROUP BY 1"


@query(f"WITH {_FIND}, l AS ({_GROUP.format('NOT late')}), s AS ({_GROUP.format('late')}) SELECT coalesce(l.fingerprint, s.fingerprint) AS fingerprint, coalesce(least(l.lo, s.lo), l.lo, s.lo) AS first_observed_at, coalesce(greatest(l.hi, s.hi), l.hi, s.hi) AS last_observed_at, coalesce(l.r1, s.r1) AS first_run_id, coalesce(s.r2, l.r2) AS last_run_id, coalesce(l.n, 0) + coalesce(s.n, 0) AS occurrence_count, CASE WHEN s.fingerprint IS NULL THEN {_NOW} END AS resolved_at, coalesce(s.severity, l.severity) AS severity, coalesce(l.session_key, s.session_key) AS session_key, coalesce(l.bill, s.bill) AS bill FROM l FULL JOIN s ON l.fingerprint = s.fingerprint")
def s9_anomaly_ledger_runs(t: Tables) -> DataFrame:
    rows = ledgers.with_identity(t.found, t.docid, t.billid).withColumn("fingerprint", ledgers.anomaly_fingerprint()).withColumnRenamed("at_", "at")
    blank = rows.limit(0).select("fingerprint", *[F.lit(None).cast(c).alias(n) for n, c in (("first_observed_at", "timestamp"), ("last_observed_at", "timestamp"), ("first_run_id", "bigint"), ("last_run_id", "bigint"), ("occurrence_count", "bigint"), ("resolved_at", "timestamp"))], "severity", "session_key", "bill")
    ledger = ledgers.merge_findings(blank, rows.where("not late"), ["fingerprint"], ["severity"], ["session_key", "bill"]).withColumn("resolved_at", _now())
    return ledgers.merge_findings(ledger, rows.where("late"), ["fingerprint"], ["severity"], ["session_key", "bill"])


_ERR = """k AS (SELECT *, sha256(concat_ws('|', stage, error_class, session_key, bill, source_entity_type, source_id, message)) AS fp, sha256(concat_ws(chr(31), stage, error_class, message, session_key, bill, source_entity_type, source_id, coalesce(CAST(document_id AS VARCHAR), ''), source_url)) AS wide, id % 2 = 0 AS late FROM werr)"""


@query(f"WITH {_ERR}, l AS (SELECT run_id, fp, min(last_occurred_at) AS lo, max(last_occurred_at) AS hi, count(*) AS n, arg_max(wide, id) AS wide FROM k WHERE NOT late GROUP BY 1, 2), s AS (SELECT run_id, fp, min(last_occurred_at) AS lo, max(last_occurred_at) AS hi, count(*) AS n, arg_max(wide, id) AS wide FROM k WHERE late GROUP BY 1, 2) SELECT coalesce(l.run_id, s.run_id) AS run_id, coalesce(l.fp, s.fp) AS fingerprint, coalesce(least(l.lo, s.lo), l.lo, s.lo) AS first_observed_at, coalesce(greatest(l.hi, s.hi), l.hi, s.hi) AS last_observed_at, coalesce(l.n, 0) + coalesce(s.n, 0) AS occurrence_count, coalesce(s.wide, l.wide) AS wide_fingerprint FROM l FULL JOIN s ON l.run_id = s.run_id AND l.fp = s.fp")
def s10_error_ledger_merge(t: Tables) -> DataFrame:
    rows = t.werr.withColumns({"fingerprint": ledgers.error_fingerprint(), "wide_fingerprint": ledgers.error_fingerprint(wide=True), "at": C("last_occurred_at"), "run": C("run_id")})
    rows = rows.drop("run_id").withColumnsRenamed({"run": "of_run", "id": "run_id"})  # within a run, the row's id is what orders its occurrences
    blank = rows.limit(0).select("of_run", "fingerprint", *[F.lit(None).cast(c).alias(n) for n, c in (("first_observed_at", "timestamp"), ("last_observed_at", "timestamp"), ("first_run_id", "bigint"), ("last_run_id", "bigint"), ("occurrence_count", "bigint"), ("resolved_at", "timestamp"))], "wide_fingerprint")
    keys, latest = ["of_run", "fingerprint"], ["wide_fingerprint"]
    ledger = ledgers.merge_findings(blank, rows.where("run_id % 2 <> 0"), keys, latest, [])
    return ledgers.merge_findings(ledger, rows.where("run_id % 2 = 0"), keys, latest, []).select(C("of_run").alias("run_id"), "fingerprint", "first_observed_at", "last_observed_at", "occurrence_count", "wide_fingerprint")


@query(f"""SELECT id, CASE WHEN resolved_at IS NOT NULL THEN resolved_at WHEN id IN (SELECT item_key FROM item WHERE status = 'completed' AND ts < TIMESTAMP '2024-01-02') OR (bill IN ('HB1', 'HB2') AND anomaly_type IN ('page_only', 'source_only')) OR (bill IS NULL AND session_key = '1994R1' AND anomaly_type = 'type_drift') THEN {_NOW} END AS resolved_at FROM wanom""")
def s11_resolve_anomalies(t: Tables) -> DataFrame:
    ids = t.item.where("status = 'completed' and ts < timestamp '2024-01-02'").select(C("item_key").alias("id"))
    bills = t.spark.createDataFrame([(b, a) for b in ("HB1", "HB2") for a in ("page_only", "source_only")], "bill string, anomaly_type string")
    sessions = t.spark.createDataFrame([("1994R1", "type_drift")], "session_key string, anomaly_type string")
    return ledgers.resolve_anomalies(t.wanom, _now(), ids, bills, sessions).select("id", "resolved_at")


@query(f"SELECT id, CASE WHEN resolved_at IS NOT NULL THEN resolved_at WHEN source_id <> '7' AND EXISTS (SELECT 1 FROM wanom a WHERE a.severity = 'error' AND a.source_entity_type = e.source_entity_type AND a.source_id = e.source_id) THEN {_NOW} WHEN source_id = '7' AND bill IN (SELECT bill FROM wanom WHERE severity = 'info') THEN {_NOW} END AS resolved_at FROM werr e")
def s11_resolve_errors(t: Tables) -> DataFrame:
    errors = t.werr.withColumn("source_id", F.when(C("source_id") != "7", C("source_id")))
    return ledgers.resolve_errors(errors, t.wanom.where("severity = 'error'"), t.wanom.where("severity = 'info' and bill is not null"), _now()).select("id", "resolved_at")


_CHECKS = "SELECT l_orderkey AS bill_id, CASE WHEN l_returnflag = 'A' THEN 'testimony' ELSE 'committee_documents' END AS family, l_shipdate AS checked_at, CASE CAST(l_partkey % 4 AS int) WHEN 0 THEN 'checked_zero' WHEN 1 THEN 'failed_fetch' WHEN 2 THEN 'parser_anomalous' ELSE 'checked_with_records' END AS status, l_suppkey AS displayed_count, l_partkey AS p FROM lineitem"
_LATEST = "SELECT bill_id, family, max(checked_at) AS n_at, max(status) FILTER (checked_at = top) AS n_status, arg_max(displayed_count, epoch_us(checked_at)::HUGEINT * 1000000 + displayed_count) FILTER (status LIKE 'checked%') AS n_count FROM (SELECT *, max(checked_at) OVER (PARTITION BY bill_id, family) AS top FROM c WHERE {}) GROUP BY 1, 2"


@query(f"WITH c AS ({_CHECKS}), o AS ({_LATEST.format('p % 3 = 0')}), n AS ({_LATEST.format('p % 3 <> 0')}) SELECT coalesce(o.bill_id, n.bill_id) AS bill_id, coalesce(o.family, n.family) AS family, CASE WHEN n.n_at IS NOT NULL AND (o.n_at IS NULL OR n.n_at >= o.n_at) THEN n.n_status ELSE o.n_status END AS status, CASE WHEN n.n_at IS NOT NULL AND (o.n_at IS NULL OR n.n_at >= o.n_at) THEN n.n_at ELSE o.n_at END AS checked_at, CASE WHEN n.n_at IS NOT NULL AND (o.n_at IS NULL OR n.n_at >= o.n_at) THEN coalesce(n.n_count, o.n_count) ELSE o.n_count END AS displayed_count FROM o FULL JOIN n ON o.bill_id = n.bill_id AND o.family = n.family")
def s13_merge_checks(t: Tables) -> DataFrame:
    checks = t.spark.sql(_CHECKS.replace("FROM lineitem", f"FROM {t.names['lineitem']}"))
    state = ledgers.merge_checks(checks.limit(0).select("bill_id", "family", "status", "checked_at", "displayed_count"), checks.where("p % 3 = 0"))
    return ledgers.merge_checks(state, checks.where("p % 3 <> 0"))


@query("SELECT DISTINCT doc_key, CASE WHEN bill_id IN (SELECT bill_id FROM bill WHERE measure_prefix = 'HB') THEN doc_key IN (SELECT doc_key FROM probe) ELSE displayed END AS displayed FROM doc")
def s13_displayed_after_checks(t: Tables) -> DataFrame:
    checks = t.bill.select("bill_id", F.lit("all").alias("family"), F.when(C("measure_prefix") == "HB", "checked_zero").otherwise("failed_fetch").alias("status"))
    return ledgers.displayed_after(t.doc.withColumn("family", F.lit("all")), checks, t.probe).select("doc_key", "displayed").distinct()


_PROBES = "SELECT l_orderkey AS k, max(l_shipdate) AS at_, arg_max(l_partkey, epoch_us(l_shipdate)::HUGEINT * 10000000 + l_partkey) AS size FROM lineitem WHERE {} GROUP BY 1"


@query(f"WITH o AS ({_PROBES.format('l_linenumber <= 2')}), n AS ({_PROBES.format('l_linenumber > 2')}) SELECT coalesce(o.k, n.k) AS l_orderkey, CASE WHEN n.at_ IS NOT NULL AND (o.at_ IS NULL OR n.at_ >= o.at_) THEN n.at_ ELSE o.at_ END AS probed_at, CASE WHEN n.at_ IS NOT NULL AND (o.at_ IS NULL OR n.at_ >= o.at_) THEN n.size ELSE o.size END AS size FROM o FULL JOIN n ON o.k = n.k")
def s14_merge_probes(t: Tables) -> DataFrame:
    probes = t.lineitem.select("l_orderkey", "l_linenumber", C("l_shipdate").alias("probed_at"), C("l_partkey").alias("size"))
    known = ledgers.merge_probes(probes.limit(0).select("l_orderkey", "probed_at", "size"), probes.where("l_linenumber <= 2"), "l_orderkey")
    return ledgers.merge_probes(known, probes.where("l_linenumber > 2"), "l_orderkey")


_V = """v AS (SELECT concat(source, '/', lang) AS document, sha256(text) AS sha256, doc_id, n_chars AS size FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
known AS (SELECT document, sha256, size, row_number() OVER (PARTITION BY document ORDER BY doc_id) AS version FROM v WHERE doc_id % 3 = 0), tops AS (SELECT document, max(version) AS top FROM known GROUP BY 1), olds AS (SELECT document, sha256, min(version) AS old FROM known GROUP BY 1, 2),
new AS (SELECT document, sha256, min(doc_id) AS seen, max(doc_id) AS last, arg_max(size, doc_id) AS size FROM v WHERE doc_id % 3 <> 0 GROUP BY 1, 2),
num AS (SELECT n.*, old IS NULL AS is_new, coalesce(old, coalesce(top, 0) + row_number() OVER (PARTITION BY n.document, old IS NULL ORDER BY seen)) AS version FROM new n LEFT JOIN olds o ON n.document = o.document AND n.sha256 = o.sha256 LEFT JOIN tops t ON n.document = t.document)"""


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    rows = t.documents.where("text is not null and lang is not null and source is not null").select(F.concat_ws("/", "source", "lang").alias("document"), F.sha2("text", 256).alias("sha256"), C("doc_id").alias("seen"), C("n_chars").cast("bigint").alias("size"))
    known = rows.where("seen % 3 = 0").withColumn("version", F.row_number().over(Window.partitionBy("document").orderBy("seen")).cast("bigint"))
    docs = known.groupBy("document").agg(F.max("version").alias("current_version"), F.max_by("sha256", "version").alias("sha256"), F.max_by("size", "version").alias("size")).withColumn("status", F.lit("queued"))
    return archive.append_versions(docs, known.drop("seen"), rows.where("seen % 3 <> 0"))


@query(f"WITH {_V} SELECT document, CAST(version AS BIGINT) AS version, sha256, CAST(size AS BIGINT) AS size FROM known UNION ALL SELECT document, CAST(version AS BIGINT), sha256, CAST(size AS BIGINT) FROM num WHERE is_new")
def s15_append_versions(t: Tables) -> DataFrame:
    return _versions(t)[0]


@query(f"WITH {_V}, cur AS (SELECT document, arg_max(version, last) AS version, arg_max(sha256, last) AS sha256, arg_max(size, last) AS size FROM num GROUP BY 1), old AS (SELECT document, max(version) AS version, arg_max(sha256, version) AS sha256, arg_max(size, version) AS size FROM known GROUP BY 1) SELECT o.document, CAST(coalesce(c.version, o.version) AS BIGINT) AS current_version, coalesce(c.sha256, o.sha256) AS sha256, CAST(coalesce(c.size, o.size) AS BIGINT) AS size, CASE WHEN c.document IS NULL THEN 'queued' ELSE 'downloaded' END AS status FROM old o LEFT JOIN cur c ON c.document = o.document")
def s15_current_versions(t: Tables) -> DataFrame:
    return _versions(t)[1]


_ACT = "SELECT concat(CAST(1992 + user_id % 9 AS string), 'R1') AS session_key, CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'finished' WHEN 'purchase' THEN 'download' WHEN 'signup' THEN 'stopped' ELSE 'finished' END AS event, event_id AS run_id, ts AS at_, CASE WHEN event_id % 3 = 0 THEN 'inventory_complete' WHEN event_id % 3 = 1 THEN 'inventory_incomplete' ELSE 'inventory_complete_with_errors' END AS outcome FROM events"


@query(f"""WITH a AS ({_ACT}), n AS (SELECT session_key, arg_max(event, run_id) FILTER (event <> 'download') AS e, arg_max(outcome, run_id) FILTER (event <> 'download') AS o, max(run_id) FILTER (event <> 'download') AS r, max(at_) FILTER (event = 'started') AS st, max(at_) FILTER (event = 'finished') AS fi, max(run_id) FILTER (event = 'finished' AND outcome <> 'inventory_incomplete') AS ok, max(at_) FILTER (event = 'download') AS dl FROM a GROUP BY 1)
SELECT coalesce(s.session_key, n.session_key) AS session_key, coalesce(CASE e WHEN 'started' THEN 'inventory_running' WHEN 'stopped' THEN 'interrupted' ELSE o END, CASE WHEN s.session_key IS NOT NULL THEN 'inventory_failed' END) AS inventory_status, st AS last_started_at, coalesce(fi, s.begin_date) AS last_completed_at, coalesce(r, CASE WHEN s.session_key IS NOT NULL THEN -1 END) AS last_run_id, coalesce(ok, CASE WHEN s.session_key IS NOT NULL THEN -1 END) AS last_successful_run_id, dl AS last_download_at FROM sess s FULL JOIN n ON n.session_key = s.session_key""")
def s16_session_archive_state(t: Tables) -> DataFrame:
    activity = t.spark.sql(_ACT.replace("FROM events", f"FROM {t.names['events']}")).withColumnRenamed("at_", "at")
    nothing = F.lit(None).cast("timestamp")
    state = t.sess.select("session_key", F.lit("inventory_failed").alias("inventory_status"), nothing.alias("last_started_at"), C("begin_date").alias("last_completed_at"), F.lit(-1).cast("bigint").alias("last_run_id"), F.lit(-1).cast("bigint").alias("last_successful_run_id"), nothing.alias("last_download_at"))
    return ledgers.merge_session_state(state, activity)


@query("""WITH b AS (SELECT k, v AS raw, CASE WHEN k % 3 = 0 THEN 'floor_letter' ELSE 'unknown' END AS kind FROM before), a AS (SELECT k, concat(' ', lower(v)) AS raw, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 3 = 0 THEN 'floor_letter' ELSE 'unknown' END AS kind FROM after)
SELECT b.k, 'raw_type' AS drift, b.raw AS old, a.raw AS new FROM b JOIN a ON a.k = b.k WHERE lower(trim(a.raw)) <> lower(trim(b.raw)) UNION ALL SELECT b.k, 'kind', b.kind, a.kind FROM b JOIN a ON a.k = b.k WHERE a.kind IS DISTINCT FROM b.kind""")
def s17_type_drift(t: Tables) -> DataFrame:
    kind = F.when(C("k") % 3 == 0, "floor_letter").otherwise("unknown")
    before = t.before.select("k", C("v").alias("raw_type"), kind.alias("kind"))
    return ledgers.type_drift(before, t.after.select("k", F.concat(F.lit(" "), F.lower("v")).alias("raw_type"), F.when(C("k") % 4 != 0, kind).alias("kind")), "k")


_FIT = "document_kind IN ('public_testimony', 'committee_presentation', 'floor_letter') AND trim(coalesce(canonical_download_url, '')) <> ''"


def _items(t: Tables) -> DataFrame:
    """Items of a run: every other document of each bill, and bills, which are no documents."""
    return t.doc.where("source_id % 2 = 1").select(F.lit("document").alias("item_type"), C("doc_key").alias("item_key")).union(t.doc.select(F.lit("bill"), C("bill_id").cast("string")))


@query(f"SELECT DISTINCT CAST(99 AS BIGINT) AS run_id, 'document' AS item_type, doc_key AS item_key, d.bill_id, session_key, 'queued' AS status FROM doc d JOIN bill b ON d.bill_id = b.bill_id WHERE download_status IN ('failed_retryable', 'failed_terminal') AND {_FIT} AND CAST(substr(session_key, 1, 4) AS INT) >= 1994 AND d.source_id % 2 = 1")
def s21_retry_items(t: Tables) -> DataFrame:
    return archive.retry_items(99, t.doc, t.bill, 1994, True, _items(t))


@query(f"SELECT DISTINCT CAST(o AS INT) AS ordinal, b.session_key, doc_key FROM doc d JOIN bill b ON d.bill_id = b.bill_id JOIN (SELECT session_key, row_number() OVER (ORDER BY begin_date, session_key) AS o FROM sess) s ON s.session_key = b.session_key WHERE CAST(substr(b.session_key, 1, 4) AS INT) % 3 > 0 AND d.source_presence IN ('active', 'unknown') AND first_seen_at <= TIMESTAMP '1998-01-01' AND {_FIT} AND download_status IN ('discovered', 'queued', 'failed_retryable', 'changed_remote') AND d.source_id % 2 = 0")
def s22_ordered_work_list(t: Tables) -> DataFrame:
    from docketlake.plans.model_queries import f7_session_ordinal

    year = F.substring("session_key", 1, 4).cast("int")
    states = t.sess.select("session_key", F.when(year % 3 == 0, "interrupted").when(year % 3 == 1, "inventory_complete").otherwise("inventory_complete_with_errors").alias("inventory_status"))
    return archive.work_list(f7_session_ordinal(t), states, t.doc, t.bill, _items(t), F.lit("1998-01-01").cast("timestamp"), filters.RETRYABLE, filters.PAYLOAD_KINDS)


_SYNC = "SELECT session_key, CASE measure_prefix WHEN 'HB' THEN 'Measures' WHEN 'SB' THEN 'Committees' ELSE 'FloorLetters' END AS entity, max(source_modified_at) AS cursor, min(source_modified_at) AS last_full_at, max(bill_id) AS last_successful_run_id, 'complete' AS outcome, count(*) > 5 AS complete FROM {bill} GROUP BY 1, 2"


@query("WITH s AS (" + _SYNC.format(bill="bill") + ") SELECT session_key, entity, CASE WHEN entity = 'Committees' THEN cursor END AS cursor, CASE WHEN entity = 'Committees' THEN last_full_at END AS last_full_at, CASE WHEN entity = 'Committees' THEN last_successful_run_id END AS last_successful_run_id, CASE WHEN entity = 'Committees' THEN outcome ELSE 'invalidated_expanded_measure_scope' END AS outcome, entity = 'Committees' AND complete AS complete FROM s")
def s25_invalidate_scope(t: Tables) -> DataFrame:
    sessions = t.sess.select("session_key", F.lit("inventory_complete").alias("inventory_status"), C("end_date").alias("last_completed_at"), F.lit(1).cast("bigint").alias("last_successful_run_id"))
    return ledgers.invalidate_scope(t.sql(_SYNC), sessions, ["HB", "SB"], ["HB", "SB", "HJR"], ["Measures", "FloorLetters"])[0]


@query("SELECT session_key, 'not_started' AS inventory_status, CAST(NULL AS TIMESTAMP) AS last_completed_at, CAST(NULL AS BIGINT) AS last_successful_run_id FROM sess")
def s25_invalidated_sessions(t: Tables) -> DataFrame:
    sessions = t.sess.select("session_key", F.lit("inventory_complete").alias("inventory_status"), C("end_date").alias("last_completed_at"), F.lit(1).cast("bigint").alias("last_successful_run_id"))
    return ledgers.invalidate_scope(t.sql(_SYNC), sessions, ["HB", "SB"], ["HB", "HJR"], ["Measures"])[1]


@query("SELECT bill_id, CASE WHEN source_presence = 'unknown' THEN 'not_applicable' ELSE 'checked_zero' END AS status, CASE WHEN source_presence = 'unknown' OR bill_id IN (SELECT bill_id FROM doc WHERE document_kind = 'public_testimony') THEN 'testimony' ELSE 'committee_documents' END AS family FROM bill")
def s26_rekey_families(t: Tables) -> DataFrame:
    results = t.bill.select("bill_id", F.when(C("source_presence") == "unknown", "not_applicable").otherwise("checked_zero").alias("status"))
    return ledgers.rekey_families(results, t.doc.where("document_kind = 'public_testimony'"))


_ATTEMPT = "CASE CAST(bill_id % 7 AS int) WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_404' WHEN 2 THEN 'ok' WHEN 3 THEN 'low_space' WHEN 4 THEN 'invalid_signature' WHEN 5 THEN 'http_429' END"


@query(f"SELECT doc_key, CASE WHEN download_status = 'downloaded' AND source_id % 3 > 0 AND bill_id % 6 > 0 THEN 'skipped_valid' WHEN download_status = 'failed_terminal' THEN 'preserved_terminal' WHEN {_ATTEMPT} IN ('timeout', 'low_space', 'http_429') THEN 'failed_retryable' WHEN {_ATTEMPT} IN ('http_404', 'invalid_signature') THEN 'failed_terminal' WHEN {_ATTEMPT} = 'ok' THEN 'downloaded' ELSE 'queued' END AS result FROM doc")
def s27_classify_downloads(t: Tables) -> DataFrame:
    valid = (C("download_status") == "downloaded") & (C("source_id") % 3 > 0)
    return t.doc.select("doc_key", archive.download_result(C("download_status"), F.expr(_ATTEMPT), valid, C("bill_id") % 6 == 0, False).alias("result"))


@query("SELECT user_id, CASE WHEN user_id % 5 = 0 THEN '2030-01-01 00:00:00' ELSE arg_max(raw, o) END AS cursor FROM (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS raw, CAST(epoch(ts) AS HUGEINT) * 1000000 - event_id AS o FROM events) GROUP BY 1")
def e10_cursor_with_prior(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("raw"), "event_id")
    prior = t.events.select("user_id", F.when(C("user_id") % 5 == 0, "2030-01-01 00:00:00").when(C("user_id") % 5 == 1, "unreadable").otherwise("1970-01-01 00:00:00").alias("cursor")).distinct()
    return archive.cursor_text(rows, prior, "user_id", "raw", "event_id")


@query("SELECT k, list_transform(x, lambda y: y) AS keys FROM (SELECT o_custkey AS k, CASE WHEN o_custkey % 2 = 0 THEN [concat('S', o_custkey % 7), 'X'] ELSE ['X', concat('S', o_custkey % 7)] END AS x FROM (SELECT DISTINCT o_custkey FROM orders))")
def h6_ordered_keys(t: Tables) -> DataFrame:
    code = F.concat(F.lit("s"), C("k") % 7)
    keys = F.when(C("k") % 2 == 0, F.array(code, F.lit(" x"), F.lit(" "), F.upper(code))).otherwise(F.array(F.lit("X "), code, F.lit("x"), F.lit(None)))
    return archive.ordered_keys(t.orders.select(C("o_custkey").alias("k")).distinct().withColumn("keys", keys), "k", "keys")


@query("""WITH s AS (SELECT id, 0 AS o, 'source' AS title, CAST(length(text) AS BIGINT) AS size, CAST(NULL AS BOOLEAN) AS flag FROM source_side UNION ALL SELECT id, 1, 'page', NULL, NULL FROM page_side UNION ALL SELECT id, 2, message, NULL, retryable FROM err UNION ALL SELECT id, 3, message, NULL, affects_completeness FROM anom)
SELECT id, title, size, flag FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC) AS r FROM s) WHERE r = 1""")
def h4_last_of_sources(t: Tables) -> DataFrame:
    sources = [t.source_side.select("id", F.lit("source").alias("title"), F.length("text").cast("bigint").alias("size")), t.page_side.select("id", F.lit("page").alias("title")), t.err.select("id", C("message").alias("title"), C("retryable").alias("flag")), t.anom.select("id", C("message").alias("title"), C("affects_completeness").alias("flag"))]
    return archive.last_of_sources(sources, ["id"]).select("id", "title", "size", "flag")


@query("SELECT doc_key, bill_id, concat('no parent for ', bill_id) AS message FROM doc d WHERE NOT EXISTS (SELECT 1 FROM bill b WHERE b.bill_id = d.bill_id AND b.source_presence = 'active')")
def d12_orphan_errors(t: Tables) -> DataFrame:
    return archive.children(t.doc, t.bill.where("source_presence = 'active'").select("bill_id"), "bill_id")[1].select("doc_key", "bill_id", "message")


@query("SELECT bill_id, ident, held, name, CAST(row_number() OVER (PARTITION BY bill_id ORDER BY held NULLS FIRST, ident) AS INT) AS place FROM rawdoc LEFT JOIN (SELECT CommitteeCode, CommitteeName AS name FROM rawcommittee) c ON c.CommitteeCode = code")
def d13_ordered_agenda(t: Tables) -> DataFrame:
    meetings = t.rawcommittee.select(C("CommitteeCode").alias("code"), C("CommitteeName").alias("name"))
    return archive.placed(t.rawdoc.join(meetings, "code", "left"), "bill_id", [C("held").asc_nulls_first(), C("ident")]).select("bill_id", "ident", "held", "name", "place")


@query("SELECT a.session_key, CASE WHEN s.session_key IS NULL THEN 'unknown' ELSE 'not_started' END AS problem FROM (SELECT DISTINCT session_key FROM rawp) a LEFT JOIN sess s ON s.session_key = a.session_key WHERE s.session_key IS NULL OR CAST(substr(s.session_key, 1, 4) AS INT) % 3 = 0".replace("rawp", "(SELECT SessionKey AS session_key FROM rawperson UNION SELECT '2031R1')"))
def d15_unlisted_sessions(t: Tables) -> DataFrame:
    asked = t.rawperson.select(C("SessionKey").alias("session_key")).union(t.spark.createDataFrame([("2031R1",)], "session_key string")).distinct()
    year = F.substring("session_key", 1, 4).cast("int")
    states = t.sess.where(year % 3 > 0).select("session_key", F.lit("inventory_complete").alias("inventory_status"))
    return archive.unlisted_sessions(asked, t.sess, states)


@query("SELECT session_key, outcome FROM (SELECT b.session_key, CASE WHEN bool_or(download_status = 'failed_retryable') THEN 'retryable' WHEN bool_or(download_status = 'failed_terminal') THEN 'terminal' ELSE 'completed' END AS outcome FROM doc d JOIN (SELECT *, concat(session_key, bill_id % 50) AS part FROM bill) b ON d.bill_id = b.bill_id GROUP BY 1)")
def e18_session_downloads(t: Tables) -> DataFrame:
    return archive.session_downloads(t.doc, t.bill)


@query("""SELECT 'bill' AS what, CAST(bill_id AS VARCHAR) AS found FROM bill WHERE session_key = '1995R1' AND concat(measure_prefix, measure_number) = 'HB12' UNION ALL SELECT DISTINCT 'document', doc_key FROM wdoc WHERE session_key = '1994R1' AND bill_id_compact = 'HB2' AND document_kind = 'floor_letter'
UNION ALL SELECT 'run', CAST(run_id AS VARCHAR) FROM wrun WHERE run_id = 7 UNION ALL SELECT DISTINCT 'probe', CAST(content_length AS VARCHAR) FROM probe WHERE doc_key LIKE '12-%' AND content_length IS NOT NULL UNION ALL SELECT 'archive', session_key FROM sess WHERE session_key = '1996R1' UNION ALL SELECT DISTINCT 'sync', concat(session_key, measure_prefix) FROM bill WHERE session_key = '1996R1' AND measure_prefix = 'SB'""")
def c10_lookups(t: Tables) -> DataFrame:
    found = [
        (filters.lookup(t.bill.withColumn("compact", F.concat("measure_prefix", "measure_number")), session_key="1995R1", compact="HB12"), "bill", C("bill_id")),
        (filters.lookup(t.wdoc, session_key="1994R1", bill_id_compact="HB2", document_kind="floor_letter").select("doc_key").distinct(), "document", C("doc_key")),
        (filters.lookup(t.wrun, run_id=7), "run", C("run_id")),
        (t.probe.where("doc_key like '12-%' and content_length is not null").select("content_length").distinct(), "probe", C("content_length")),
        (filters.lookup(t.sess, session_key="1996R1"), "archive", C("session_key")),
        (filters.lookup(t.bill, session_key="1996R1", measure_prefix="SB").select("session_key", "measure_prefix").distinct(), "sync", F.concat("session_key", "measure_prefix")),
    ]
    return reduce(DataFrame.union, [rows.select(F.lit(what).alias("what"), value.cast("string").alias("found")) for rows, what, value in found])


_ORDERS = {
    "sessions": "SELECT session_key AS k FROM sess ORDER BY begin_date DESC, session_key DESC",
    "legislators": "SELECT LegislatorCode AS k FROM rawperson ORDER BY SessionKey, LastName NULLS FIRST, FirstName NULLS FIRST, LegislatorCode",
    "committees": "SELECT CommitteeCode AS k FROM rawcommittee ORDER BY SessionKey, CommitteeName, CommitteeCode",
    "bill_documents": "SELECT ident AS k FROM rawdoc ORDER BY bill_id, kind NULLS FIRST, held, ident",
    "versions": "SELECT CAST(doc_id AS VARCHAR) AS k FROM documents ORDER BY source NULLS FIRST, doc_id DESC",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS list, k, CAST(p AS INT) AS place FROM (SELECT k, row_number() OVER () AS p FROM ({q})) WHERE p <= 100" for n, q in _ORDERS.items()))
def g5_orders(t: Tables) -> DataFrame:
    lists = {
        "sessions": (t.sess, paging.ORDERS["sessions"], "session_key"),
        "legislators": (t.rawperson.withColumnsRenamed({"SessionKey": "session_key", "LegislatorCode": "legislator_code", "LastName": "last_name", "FirstName": "first_name"}), paging.ORDERS["legislators"], "legislator_code"),
        "committees": (t.rawcommittee.withColumnsRenamed({"SessionKey": "session_key", "CommitteeCode": "committee_code", "CommitteeName": "committee_name"}), paging.ORDERS["committees"], "committee_code"),
        "bill_documents": (t.rawdoc.withColumnsRenamed({"kind": "document_kind", "held": "meeting_date", "ident": "source_id"}), paging.ORDERS["bill_documents"], "source_id"),
        "versions": (t.documents.withColumnsRenamed({"source": "document", "doc_id": "version"}), paging.ORDERS["versions"], "version"),
    }
    frames = []
    for name, (rows, order, key) in lists.items():
        top = paging.page(rows, paging.named_order(order), 100)
        numbered = top.agg(F.collect_list(C(key).cast("string")).alias("ks")).select(F.posexplode("ks").alias("p", "k"))  # a page is at most 500 rows
        frames.append(numbered.select(F.lit(name).alias("list"), "k", (C("p") + 1).alias("place")))
    return reduce(DataFrame.union, frames)


@query("""SELECT 'download_status' AS rule, count(*) FILTER (download_status NOT IN ('discovered', 'queued', 'downloaded', 'failed_retryable', 'failed_terminal')) AS violations FROM wdoc UNION ALL SELECT 'source_presence', count(*) FILTER (source_presence NOT IN ('active', 'unknown')) FROM wdoc UNION ALL SELECT 'document_kind', count(*) FILTER (document_kind NOT IN ('public_testimony', 'legacy_testimony', 'committee_presentation', 'floor_letter', 'committee_document_other', 'unknown')) FROM wdoc
UNION ALL SELECT 'submitter is not blank', 0 UNION ALL SELECT 'downloaded_bytes is not negative', 0 UNION ALL SELECT 'sha256 has 64 hex digits', count(*) FILTER (bill_id % 9 = 0) FROM wdoc UNION ALL SELECT 'prefix fits chamber', count(*) FILTER (bill_id % 5 = 0) FROM wdoc UNION ALL SELECT 'display event has a flag', count(*) FILTER (displayed IS NULL AND testimony_position = 'Oppose') FROM wdoc""")
def m1_schema_constraints(t: Tables) -> DataFrame:
    rows = t.wdoc.withColumns({"sha256": F.when(C("bill_id") % 9 == 0, "abc").otherwise(F.sha2("doc_key", 256)), "measure_prefix": F.lit("HB"), "bill_chamber": F.when(C("bill_id") % 5 == 0, "Senate").otherwise("House")})
    enums = {"download_status": ["discovered", "queued", "downloaded", "failed_retryable", "failed_terminal"], "source_presence": ["active", "unknown"], "document_kind": quality.DOCUMENT_KINDS}
    rules = quality.domain_rules(enums, texts=["submitter"], counts=["downloaded_bytes"], hashes=["sha256"])
    rules |= {"prefix fits chamber": quality.prefix_fits(C("measure_prefix"), C("bill_chamber")), "display event has a flag": (C("testimony_position") != "Oppose") | C("testimony_position").isNull() | C("displayed").isNotNull()}
    return quality.constraint_audit(rows, rules)


@query("SELECT id, last_at, deliveries FROM (SELECT id, max(seen_at) AS last_at, count(*) AS deliveries FROM (SELECT user_id * 1000 + event_id % 40 AS id, ts AS seen_at FROM events WHERE ts < TIMESTAMP '2024-01-04' UNION ALL SELECT user_id * 1000 + event_id % 40, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03') GROUP BY 1)")
def s3_redelivered(t: Tables) -> DataFrame:
    rows = t.events.select((C("user_id") * 1000 + C("event_id") % 40).alias("id"), C("ts").alias("at"))
    return merge.redelivered(rows.where("at < timestamp '2024-01-04'"), rows, "id", "at", F.lit("2024-01-03").cast("timestamp"))
