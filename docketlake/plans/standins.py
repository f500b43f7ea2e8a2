"""Stand-in tables: the inventory's tables as views over the given ones. Each statement is valid in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_KEY = "concat_ws('-', CAST(l_orderkey AS string), CAST(l_linenumber AS string), CAST(l_partkey AS string), CAST(l_suppkey AS string))"
VIEWS = {
    "sess": "SELECT concat(CAST(year(o_orderdate) AS string), 'R1') AS session_key, min(o_orderdate) AS begin_date, max(o_orderdate) AS end_date FROM {orders} GROUP BY 1",
    "bill": "SELECT o_orderkey AS bill_id, concat(CAST(year(o_orderdate) AS string), 'R1') AS session_key, CASE CAST(o_orderkey % 12 AS int) WHEN 0 THEN 'HB' WHEN 1 THEN 'SB' WHEN 2 THEN 'HJR' WHEN 3 THEN 'SJR' WHEN 4 THEN 'HCR' WHEN 5 THEN 'SCR' WHEN 6 THEN 'HR' WHEN 7 THEN 'SR' WHEN 8 THEN 'HJM' WHEN 9 THEN 'SJM' WHEN 10 THEN 'HM' ELSE 'SM' END AS measure_prefix, CASE WHEN o_orderkey % 2 = 0 THEN 'House' ELSE 'Senate' END AS bill_chamber, CAST(o_orderkey AS string) AS measure_number, o_orderpriority AS bill_title, CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS string) WHEN 'P' THEN '  ' END AS chapter_number, o_custkey AS sponsor_code, o_orderdate AS source_modified_at, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' WHEN o_orderkey % 89 = 0 THEN 'unknown' ELSE 'active' END AS source_presence FROM {orders}",
    "doc": f"SELECT {_KEY} AS doc_key, l_orderkey AS bill_id, l_linenumber AS source_id, CASE WHEN l_partkey % 23 = 0 THEN 'unknown' WHEN l_returnflag = 'A' THEN 'public_testimony' WHEN l_returnflag = 'R' THEN 'committee_presentation' WHEN l_linestatus = 'O' THEN 'floor_letter' ELSE 'committee_document_other' END AS document_kind, CASE CAST(l_partkey % 8 AS int) WHEN 0 THEN 'discovered' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'failed_retryable' WHEN 3 THEN 'failed_terminal' WHEN 4 THEN 'not_applicable' WHEN 5 THEN 'downloaded' WHEN 6 THEN 'changed_remote' ELSE 'queued' END AS download_status, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN '  ' ELSE concat('https://host', CAST(l_suppkey % 5 AS string), '.example.com/d/', CAST(l_partkey AS string)) END AS canonical_download_url, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (l_linenumber % 2 = 0) END AS displayed, CASE WHEN l_suppkey % 17 = 0 THEN 'missing' ELSE 'active' END AS source_presence, CAST(floor(l_extendedprice) AS bigint) AS downloaded_bytes, l_shipdate AS first_seen_at FROM {{lineitem}}",
    "probe": f"SELECT DISTINCT {_KEY} AS doc_key, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(floor(l_extendedprice) AS bigint) END AS content_length FROM {{lineitem}} WHERE l_suppkey % 4 <> 0",
    "err": "SELECT event_id AS id, user_id AS run_id, ts AS last_occurred_at, CASE WHEN event_id % 4 = 0 THEN ts END AS resolved_at, (event_id % 3 = 0) AS retryable, props AS message FROM {events} WHERE event_type = 'error'",
    "anom": "SELECT event_id AS id, user_id AS run_id, ts AS last_observed_at, CASE WHEN event_id % 5 = 0 THEN ts END AS resolved_at, (event_id % 6 = 0) AS affects_completeness, props AS message FROM {events} WHERE event_type = 'signup'",
    "item": "SELECT user_id AS run_id, event_id AS item_key, CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'skipped' WHEN 'purchase' THEN 'queued' WHEN 'signup' THEN 'failed_retryable' ELSE 'failed_terminal' END AS status, ts FROM {events}",
    "before": "SELECT o_orderkey AS k, o_orderstatus AS v, o_orderdate AS d FROM {orders} WHERE o_orderkey % 10 <> 3",
    "after": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS v, o_orderdate AS d FROM {orders} WHERE o_orderkey % 10 <> 7",
    "rawmeasure": "SELECT concat(CAST(year(o_orderdate) AS string), 'R1') AS SessionKey, CASE CAST(o_orderkey % 5 AS int) WHEN 0 THEN 'hb' WHEN 1 THEN 'SB' WHEN 2 THEN 'hjr' WHEN 3 THEN 'SCR' ELSE 'X' END AS MeasurePrefix, o_orderkey AS MeasureNumber, concat(' ', o_orderpriority, ' ') AS RelatingTo, CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE o_orderpriority END AS CatchLine, o_orderstatus AS CurrentVersion, CASE CAST(o_orderkey % 4 AS int) WHEN 0 THEN 'true' WHEN 1 THEN 'No' WHEN 2 THEN ' 1 ' END AS Vetoed, CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE 'FALSE' END AS EmergencyClause, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS string) END AS ChapterNumber, o_custkey AS LCNumber, CAST(o_orderdate AS string) AS ModifiedDate FROM {orders}",
    "rawperson": "SELECT concat(CAST(1992 + c_custkey % 7 AS string), 'R1') AS SessionKey, concat('L', CAST(c_custkey AS string)) AS LegislatorCode, concat(' ', c_mktsegment) AS FirstName, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE c_name END AS LastName, CASE CAST(c_custkey % 3 AS int) WHEN 0 THEN 'h' WHEN 1 THEN 'Senate' ELSE 'J' END AS Chamber, CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'no' END AS Active, c_nationkey AS DistrictNumber FROM {customer}",
    "rawcommittee": "SELECT '1995R1' AS SessionKey, concat('C', CAST(s_suppkey AS string)) AS CommitteeCode, concat(s_name, '  Board') AS CommitteeName, CASE WHEN s_suppkey % 2 = 0 THEN 'H' ELSE 'S' END AS HouseOfAction, s_nationkey AS CommitteeId FROM {supplier}",
    "rawdoc": "SELECT DISTINCT concat(CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string), '-', CAST(l_partkey AS string), '-', CAST(l_suppkey AS string)) AS ident, l_orderkey AS bill_id, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE concat('Part  ', CAST(l_partkey AS string)) END AS title, CASE CAST(l_partkey % 4 AS int) WHEN 0 THEN 'Presentation' WHEN 1 THEN 'Agenda' WHEN 2 THEN 'Map' END AS kind, concat('C', CAST(l_suppkey AS string)) AS code, CASE WHEN l_suppkey % 3 > 0 THEN concat('https://example.org/d/', CAST(l_partkey AS string)) END AS url, CASE WHEN l_linenumber % 2 = 0 THEN 'S' ELSE 'house' END AS chamber, CAST(l_shipdate AS string) AS held, l_linenumber AS n, l_suppkey AS who FROM {lineitem}",
    "wdoc": f"SELECT {_KEY} AS doc_key, l_orderkey AS bill_id, concat('HB', CAST(l_orderkey % 300 AS string)) AS bill_id_compact, concat(CAST(1992 + l_orderkey % 7 AS string), 'R1') AS session_key, CASE WHEN l_returnflag = 'A' THEN 'public_testimony' WHEN l_returnflag = 'R' THEN 'committee_presentation' ELSE 'floor_letter' END AS document_kind, CASE CAST(l_partkey % 4 AS int) WHEN 0 THEN 'Neutral' WHEN 1 THEN 'Oppose' WHEN 2 THEN 'Support' END AS testimony_position, CASE CAST(l_partkey % 5 AS int) WHEN 0 THEN 'downloaded' WHEN 1 THEN 'failed_retryable' WHEN 2 THEN 'failed_terminal' ELSE 'discovered' END AS download_status, CASE WHEN l_linenumber % 2 = 0 THEN 'valid' ELSE 'unchecked' END AS validation_status, l_linenumber % 3 > 0 AS has_version, CASE WHEN l_suppkey % 17 = 0 THEN 'missing' ELSE 'active' END AS source_presence, concat('C', CAST(l_suppkey % 30 AS string)) AS committee_code, CASE WHEN l_suppkey % 4 > 0 THEN concat('Board of ', l_linestatus) END AS committee_name, CASE WHEN l_linenumber <> 4 THEN concat('Person ', CAST(l_suppkey AS string)) END AS submitter, CASE WHEN l_linenumber % 3 = 0 THEN concat('City ', CAST(l_suppkey % 9 AS string)) END AS city_organization, CASE WHEN l_linenumber % 3 = 1 THEN concat('Club ', CAST(l_suppkey % 9 AS string)) END AS on_behalf_of, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber % 2 = 0 END AS displayed, CASE WHEN l_partkey % 11 > 0 THEN concat('https://example.org/d/', CAST(l_partkey AS string)) END AS canonical_download_url, CAST(floor(l_extendedprice) AS bigint) AS downloaded_bytes FROM {{lineitem}}",
    "wrun": "SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'inventory_backfill' WHEN c_custkey % 3 = 1 THEN 'archive_download' ELSE 'bill_collection' END AS run_type, CASE CAST(c_custkey % 7 AS int) WHEN 0 THEN 'canceled' WHEN 1 THEN 'paused' WHEN 2 THEN 'completed' WHEN 3 THEN 'completed_with_errors' ELSE 'running' END AS status, concat(CAST(1992 + c_custkey % 7 AS string), 'R1') AS requested_session_key, concat('HB', CAST(c_custkey % 90 AS string)) AS requested_bill, CASE WHEN c_custkey % 4 > 0 THEN concat('name ', c_mktsegment) END AS requested_scope_json, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 ELSE 0 END AS error_count, CASE WHEN c_custkey % 6 < 5 THEN c_custkey % 2 END AS bills_completed, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS sessions_incomplete, 0 AS sessions_failed, CASE WHEN c_custkey % 8 = 0 THEN 'stopped' END AS fatal_error, concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS string), 2, '0')) AS finished_at FROM {customer}",
    "werr": "SELECT event_id AS id, user_id AS run_id, concat(CAST(1992 + event_id % 7 AS string), 'R1') AS session_key, concat('HB', CAST(event_id % 200 AS string)) AS bill, CASE CAST(event_id % 3 AS int) WHEN 0 THEN 'download_documents' WHEN 1 THEN 'inventory' ELSE 'reconcile' END AS stage, CASE WHEN event_id % 2 = 0 THEN 'FloorLetter' ELSE 'CommitteeMeetingDocument' END AS source_entity_type, CAST(event_id % 50 AS string) AS source_id, CASE WHEN event_id % 4 > 0 THEN event_id % 6000 END AS document_id, CASE WHEN event_id % 5 < 3 THEN 'HttpError' ELSE 'Timeout' END AS error_class, (event_id % 3 = 0) AS retryable, props AS message, 1 + event_id % 5 AS attempt_count, ts AS first_occurred_at, ts AS last_occurred_at, CASE WHEN event_id % 4 = 0 THEN ts END AS resolved_at, concat('https://example.org/', CAST(event_id AS string)) AS source_url FROM {events} WHERE event_type IN ('error', 'click')",
    "wanom": "SELECT event_id AS id, user_id AS first_run_id, user_id % 40 AS last_run_id, concat(CAST(1992 + event_id % 7 AS string), 'R1') AS session_key, CASE WHEN event_id % 3 > 0 THEN concat('HB', CAST(event_id % 200 AS string)) END AS bill, CASE WHEN event_id % 2 = 0 THEN 'FloorLetter' ELSE 'CommitteeMeetingDocument' END AS source_entity_type, CAST(event_id % 50 AS string) AS source_id, CASE WHEN event_id % 4 > 0 THEN event_id % 6000 END AS document_id, CASE CAST(event_id % 4 AS int) WHEN 0 THEN 'source_only' WHEN 1 THEN 'page_only' WHEN 2 THEN 'count_mismatch' ELSE 'type_drift' END AS anomaly_type, CASE CAST(event_id % 3 AS int) WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'error' END AS severity, (event_id % 6 = 0) AS affects_completeness, props AS message, 1 + event_id % 4 AS occurrence_count, ts AS first_observed_at, ts AS last_observed_at, CASE WHEN event_id % 5 = 0 THEN ts END AS resolved_at, concat('https://example.org/', CAST(event_id AS string)) AS source_url FROM {events} WHERE event_type IN ('signup', 'view')",
    "docid": "SELECT o_orderkey AS document_id, CASE CAST(o_orderkey % 3 AS int) WHEN 0 THEN 'public_testimony' WHEN 1 THEN 'floor_letter' ELSE 'committee_presentation' END AS document_kind, CASE WHEN o_orderkey % 5 = 0 THEN 503 WHEN o_orderkey % 5 = 1 THEN 404 END AS http_status, concat(CAST(year(o_orderdate) AS string), 'R1') AS session_key, concat('HB', CAST(o_orderkey AS string)) AS bill, o_orderkey % 400 AS bill_id FROM {orders}",
    "inbill": "SELECT concat(CAST(year(o_orderdate) AS string), 'R1') AS session_key, CASE CAST(o_orderkey % 5 AS int) WHEN 0 THEN 'hb' WHEN 1 THEN 'SB' WHEN 2 THEN 'HJR' WHEN 3 THEN 'SCR' ELSE 'SM' END AS measure_prefix, o_orderkey AS measure_number, CASE WHEN o_orderkey % 13 = 0 THEN 'HB 1' WHEN o_orderkey % 5 = 1 THEN concat('sb-', CAST(o_orderkey AS string)) END AS bill_id_compact, CASE WHEN o_orderkey % 17 = 0 THEN 'Joint' WHEN o_orderkey % 5 = 2 THEN ' House' END AS bill_chamber, CASE WHEN o_orderkey % 19 = 0 THEN 'Petition' END AS measure_type, o_orderpriority AS bill_title FROM {orders} WHERE o_orderkey % 10 <> 7",
    "oldbill": "SELECT concat(CAST(year(o_orderdate) AS string), 'R1') AS session_key, concat(CASE CAST(o_orderkey % 5 AS int) WHEN 0 THEN 'HB' WHEN 1 THEN 'SB' WHEN 2 THEN 'HJR' WHEN 3 THEN 'SCR' ELSE 'SM' END, CAST(o_orderkey AS string)) AS bill_id_compact, 'old' AS bill_title, CASE WHEN o_orderkey % 4 = 0 THEN 'missing' ELSE 'active' END AS source_presence, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS missing_since, o_orderdate AS first_collected_at FROM {orders} WHERE o_orderkey % 10 <> 3",
    "refs": "SELECT c_custkey AS k, concat(CAST(1992 + c_custkey % 7 AS string), 'R1') AS session_key, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE concat('K', CAST(c_custkey AS string)) END AS code, c_name AS name, c_mktsegment AS seg FROM {customer}",
    "found": "SELECT CASE CAST(event_id % 3 AS int) WHEN 0 THEN 'source_only' WHEN 1 THEN 'page_only' ELSE 'type_drift' END AS anomaly_type, CASE WHEN event_id % 4 = 0 THEN ' 1999r1' END AS session_key, CASE WHEN event_id % 5 = 0 THEN 'HB7' END AS bill, CASE WHEN event_id % 3 > 0 THEN user_id * 7 END AS document_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS bill_id, 'FloorLetter' AS source_entity_type, CAST(user_id AS string) AS source_id, CAST(NULL AS string) AS previous_value, CASE WHEN user_id % 2 = 0 THEN event_type END AS current_value, event_type AS message, CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'error' END AS severity, event_id AS run_id, ts AS at_, event_id % 2 = 0 AS late FROM {events}",
    "billid": "SELECT o_orderkey AS bill_id, concat(CAST(year(o_orderdate) AS string), 'R1') AS session_key, concat('SB', CAST(o_orderkey AS string)) AS bill FROM {orders}",
    "source_side": "SELECT doc_id AS id, text FROM {documents} WHERE doc_id % 5 <> 0",
    "page_side": "SELECT doc_id AS id, text FROM {documents} WHERE doc_id % 7 <> 0",
}
_LINE = "l_orderkey l_partkey l_suppkey l_linenumber".split()
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in _LINE)
#: Stand-ins that Spark derives another way, with the same rows: lines whose keys are whole are told apart by them and the date, and all columns are made afterwards, so no made text is shuffled.
DERIVED = {"rawdoc": VIEWS["rawdoc"].replace("SELECT DISTINCT", "SELECT").replace("{lineitem}", f"(SELECT DISTINCT {', '.join(_LINE)}, l_shipdate FROM {{lineitem}} WHERE {_WHOLE})") + f" UNION ALL {VIEWS['rawdoc']} WHERE NOT ({_WHOLE})"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """Tables and stand-ins of one directory as DataFrames, by attribute or by SQL over {name}."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.sql(DERIVED.get(name, VIEWS[name]).format(**self.names))
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, query: str) -> DataFrame:
        """A query over {table} and {stand-in}; stand-ins become subqueries."""
        views = {v: f"({text.format(**self.names)})" for v, text in (VIEWS | DERIVED).items()}
        return self.spark.sql(query.format(**self.names, **views))


def oracle(query: str) -> str:
    """DuckDB SQL: the query behind common table expressions for the stand-ins that it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", query)]
    ctes = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used]
    query = query.strip()
    if not ctes:
        return query
    if query.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {query[5:]}"
    return f"WITH {', '.join(ctes)} {query}"
