"""Queries of whole jobs, of rendered pages and of the views that combine operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.functions import records as R
from docketlake.functions import text as X
from docketlake.operators import filters, jobs, paging, rollups, searches
from docketlake.plans import model_queries, state_queries
from docketlake.plans.registry import ORACLES, query
from docketlake.plans.standins import Tables
from docketlake.sources import exports, html_tables, pages
from docketlake.streaming import loads

C = F.col
_NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def rendered_pages(lines: DataFrame, title: F.Column) -> DataFrame:
    """(page_id, html): the record table of each order as a site would render it."""
    link = F.concat(F.lit("<tr><td><a href='/Downloads/PublicTestimony/"), C("l_linenumber"), F.lit("'>"), title, F.lit("</a></td>"))
    row = F.concat(link, F.lit("<td> Supplier\n"), C("l_suppkey"), F.lit("</td><td>"), C("l_returnflag"), F.lit("</td></tr>"))
    table = F.concat(F.lit("<h2>Testimony</h2><table><tr><th>Title</th><th>Submitter</th><th>Position</th></tr>"), F.array_join(F.collect_list("row"), ""), F.lit("</table>"))
    return lines.select(C("l_orderkey").alias("page_id"), row.alias("row")).groupBy("page_id").agg(table.alias("html"))


_LINES = "SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS source_id, concat('Part & ', l_partkey) AS title, concat('Supplier ', l_suppkey) AS submitter, l_returnflag AS position FROM lineitem"


@query(f"""WITH r AS ({_LINES}), g AS (SELECT page_id, source_id, count(DISTINCT concat_ws('|', title, submitter, position)) > 1 AS conflict FROM r GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, source_id ORDER BY title, submitter, position) AS n FROM r)
SELECT f.page_id, 'publictestimony' AS family, f.source_id, title, submitter, CAST(NULL AS VARCHAR) AS on_behalf_of, position, CAST(NULL AS VARCHAR) AS organization, CAST(NULL AS VARCHAR) AS meeting, CAST(NULL AS VARCHAR) AS committee, conflict
FROM f JOIN g ON f.page_id = g.page_id AND f.source_id = g.source_id WHERE n = 1""")
def a7_table_rows(t: Tables) -> DataFrame:
    return html_tables.extract_rows(html_tables.parse_pages(rendered_pages(t.lineitem, F.concat(F.lit("Part &amp; "), C("l_partkey")))))


@query(f"""SELECT page_id, CASE WHEN c > 0 THEN 'parser_anomalous' ELSE 'checked_with_records' END AS outcome, n AS n_rows FROM (
SELECT page_id, count(*) AS n, count(*) FILTER (d > 1) AS c FROM (SELECT page_id, source_id, count(DISTINCT concat_ws('|', title, submitter, position)) AS d FROM ({_LINES}) GROUP BY 1, 2) GROUP BY 1)""")
def a8_rendered_outcomes(t: Tables) -> DataFrame:
    return html_tables.classify_pages(html_tables.parse_pages(rendered_pages(t.lineitem, F.concat(F.lit("Part &amp; "), C("l_partkey")))))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN concat('Joint ', s_name) ELSE s_name END AS display FROM supplier")
def b10_committee_display(t: Tables) -> DataFrame:
    kind = F.when(C("s_suppkey") % 3 == 0, F.upper(F.substring("s_name", 1, 5))).when(C("s_suppkey") % 3 == 1, " Joint ")
    return t.supplier.select("s_suppkey", R.committee_display(C("s_name"), kind).alias("display"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 9 > 0 THEN concat(o_orderpriority, '|', strftime(o_orderdate, '%Y-%m-%d')) END AS meeting_id FROM orders")
def b11_meeting_id(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", R.meeting_id(F.when(C("o_custkey") % 9 > 0, C("o_orderpriority")), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("meeting_id"))


@query("SELECT doc_key, CASE WHEN source_id % 2 = 1 THEN 'public_testimony' ELSE 'committee_presentation' END AS document_kind, CASE WHEN source_id % 2 = 1 THEN 'HTML testimony row' ELSE 'Presentation' END AS raw_document_type, 'page_section' AS classification_method, 'confirmed' AS confidence, CASE WHEN trim(coalesce(canonical_download_url, '')) = '' THEN NULL ELSE canonical_download_url END AS canonical_download_url, 'discovered' AS download_status FROM doc")
def b14_page_documents(t: Tables) -> DataFrame:
    rows = t.doc.select("doc_key", F.when(C("source_id") % 2 == 1, "PublicTestimony").otherwise("CommitteeMeetingDocument").alias("family"), C("canonical_download_url").alias("url"))
    return rows.select("doc_key", R.page_document(C("family"), C("url")).alias("d")).select("doc_key", "d.*")


@query("SELECT o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), CASE WHEN o_orderkey % 2 = 0 THEN '-08:00' ELSE '' END) AS raw, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 8 HOUR ELSE o_orderdate END AS at FROM orders")
def b18_source_dates(t: Tables) -> DataFrame:
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(C("o_orderkey") % 2 == 0, "-08:00").otherwise(""))
    return t.orders.select("o_orderkey", raw.alias("raw")).withColumn("at", R.source_date(C("raw")))


@query("""WITH l AS (SELECT doc_key, max(downloaded_bytes + CASE WHEN source_id = 3 THEN 1 ELSE 0 END) AS length FROM doc WHERE bill_id % 6 > 0 GROUP BY 1)
SELECT d.doc_key, downloaded_bytes, coalesce(bill_id % 7 > 0 AND bill_id % 5 > 0 AND length = downloaded_bytes, false) AS valid FROM doc d LEFT JOIN l ON l.doc_key = d.doc_key""")
def c9_valid_completed(t: Tables) -> DataFrame:
    path = F.concat(F.lit("archive/"), C("doc_key"))
    recorded = t.doc.select("doc_key", "downloaded_bytes", path.alias("local_path"), F.when(C("bill_id") % 5 > 0, C("doc_key")).otherwise("other").alias("file_name"), F.when(C("bill_id") % 7 > 0, "valid").otherwise("invalid").alias("validation_status"))
    listing = t.doc.where("bill_id % 6 > 0").groupBy(path.alias("path")).agg(F.max(C("downloaded_bytes") + F.when(C("source_id") == 3, 1).otherwise(0)).alias("length"))
    return filters.valid_completed(recorded, listing).select("doc_key", "downloaded_bytes", "valid")


@query("SELECT count(*) AS total FROM doc WHERE document_kind = 'public_testimony' AND canonical_download_url LIKE '%host1%' AND displayed")
def e20_filtered_total(t: Tables) -> DataFrame:
    return filters.document_search(t.doc, kind="public_testimony", url="HOST1", displayed="yes").agg(F.count("*").alias("total"))


@query("SELECT doc_key, row_number() OVER (PARTITION BY bill_id ORDER BY document_kind, coalesce(strftime(first_seen_at, '%Y-%m-%d'), ''), doc_key) AS place FROM doc")
def g5_bill_documents(t: Tables) -> DataFrame:
    order = Window.partitionBy("bill_id").orderBy("document_kind", F.coalesce(F.date_format("first_seen_at", "yyyy-MM-dd"), F.lit("")), "doc_key")
    return t.doc.select("doc_key", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(c_mktsegment, ''), coalesce(c_name, ''), c_custkey) AS place FROM customer")
def g5_people(t: Tables) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy(F.coalesce("c_mktsegment", F.lit("")), F.coalesce("c_name", F.lit("")), "c_custkey")
    return t.customer.select("c_custkey", F.row_number().over(order).cast("long").alias("place"))


@query(f"SELECT e.* FROM ({ORACLES['e2_session_export']}) e JOIN sess s ON s.session_key = e.session_key WHERE s.begin_date >= (SELECT begin_date FROM sess WHERE session_key = '1995R1')")
def r5_session_export(t: Tables) -> DataFrame:
    boundary = t.sess.where("session_key = '1995R1'").select(C("begin_date").alias("boundary"))  # one row
    inside = t.sess.join(F.broadcast(boundary), C("begin_date") >= C("boundary")).select("session_key")
    return model_queries.e2_session_export(t).join(inside, "session_key", "left_semi")


@query("SELECT (SELECT count(*) FROM sess) AS sessions_stored, (SELECT count(*) FROM bill) AS bills_stored, count(*) AS documents_discovered, count(*) FILTER (download_status = 'downloaded') AS documents_downloaded, count(*) FILTER (download_status IN ('failed_retryable', 'failed_terminal')) AS download_failures, CAST(coalesce(sum(downloaded_bytes) FILTER (download_status = 'downloaded'), 0) AS BIGINT) AS archive_bytes, (SELECT max(ts) FROM item WHERE status = 'completed') AS last_completed FROM doc")
def r8_archive_stats(t: Tables) -> DataFrame:
    done = C("download_status") == "downloaded"
    return rollups.one_row([
        t.sess.agg(F.count("*").alias("sessions_stored")),
        t.bill.agg(F.count("*").alias("bills_stored")),
        t.doc.agg(F.count("*").alias("documents_discovered"), F.count_if(done).alias("documents_downloaded"), F.count_if(C("download_status").isin("failed_retryable", "failed_terminal")).alias("download_failures"), rollups.when_sum(C("downloaded_bytes"), done).alias("archive_bytes")),
        t.item.where("status = 'completed'").agg(F.max("ts").alias("last_completed")),
    ])


@query("SELECT * FROM (" + ORACLES["e11_preflight"].replace("WHERE document_kind IN", "WHERE d.bill_id IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1995, 1996)) AND document_kind IN") + ")")
def r10_download_preflight(t: Tables) -> DataFrame:
    scope = t.bill.where("session_key in ('1995R1', '1996R1')").join(model_queries.d15_inventoried_scope(t), "session_key", "left_semi")
    return rollups.preflight(t.doc.join(scope.select("bill_id"), "bill_id", "left_semi"), t.probe)


@query(f"""WITH o AS (SELECT bill_id, bill_title FROM bill WHERE session_key = '1996R1' AND measure_prefix IN ('HB', 'SB') AND bill_id % 10 <> 3),
n AS (SELECT bill_id, CASE WHEN bill_id % 7 = 0 THEN 'changed' ELSE bill_title END AS bill_title FROM bill WHERE session_key = '1996R1' AND measure_prefix IN ('HB', 'SB') AND bill_id % 10 <> 7)
SELECT coalesce(o.bill_id, n.bill_id) AS bill_id, coalesce(n.bill_title, o.bill_title) AS bill_title, CASE WHEN n.bill_id IS NULL THEN 'missing' ELSE 'active' END AS presence, CASE WHEN n.bill_id IS NULL THEN {_NOW} END AS missing_since, CASE WHEN o.bill_id IS NULL THEN 'new' WHEN n.bill_id IS NULL THEN 'became_missing' ELSE 'unchanged' END AS transition FROM o FULL JOIN n ON o.bill_id = n.bill_id""")
def r11_inventory_load(t: Tables) -> DataFrame:
    bill = t.bill.select("bill_id", "session_key", "measure_prefix", "bill_title", "source_modified_at")
    target, landed = bill.where("bill_id % 10 <> 3"), bill.where("bill_id % 10 <> 7").withColumn("bill_title", F.when(C("bill_id") % 7 == 0, "changed").otherwise(C("bill_title")))
    states = target.select("bill_id", F.lit("active").alias("presence"), F.lit(None).cast("timestamp").alias("missing_since"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    rows, presence, _ = jobs.inventory_load(target, states, landed, "bill_id", "1996R1", ["HB", "SB"], "source_modified_at", now)
    return presence.join(rows, "bill_id").select("bill_id", "bill_title", "presence", "missing_since", "transition")


def _reconciled(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages show two of three lines; every eleventh bill's page cannot be read; bills without a line shown say that they are empty."""
    lines = t.lineitem.where("l_linenumber % 3 <> 0 and l_orderkey % 11 <> 0").dropDuplicates(["l_orderkey", "l_linenumber"])
    full = rendered_pages(lines, F.concat(F.lit("Exhibit "), C("l_linenumber")))
    empty = F.when(C("page_id") % 11 == 0, "<h2>Testimony</h2>").otherwise("<h2>Testimony</h2><p>No items to display.</p>")
    pages = t.lineitem.select(C("l_orderkey").alias("page_id")).distinct().join(full, "page_id", "left").select("page_id", F.coalesce("html", empty).alias("html"))
    source = t.lineitem.where("l_suppkey % 4 <> 0").select(C("l_orderkey").alias("bill_id"), C("l_linenumber").alias("source_id"))
    ledger = t.bill.where("source_presence <> 'active'").select("bill_id", F.lit(None).cast("timestamp").alias("resolved_at"))
    return jobs.reconcile_pages(source, pages, state_queries.s18_candidates(t), state_queries.s19_reusable(t), ledger, F.lit("2024-06-01 00:00:00").cast("timestamp"))


_TODO = f"todo AS (SELECT bill_id FROM ({ORACLES['s18_candidates']}) WHERE bill_id NOT IN (SELECT bill_id FROM ({ORACLES['s19_reusable']})))"


@query(f"""WITH {_TODO}, s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_suppkey % 4 <> 0 AND l_orderkey IN (SELECT bill_id FROM todo)),
p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_orderkey % 11 <> 0 AND l_orderkey IN (SELECT bill_id FROM todo))
SELECT concat(coalesce(s.k, p.k), '-', coalesce(s.n, p.n)) AS record, CASE WHEN p.k IS NULL THEN 'source_only' WHEN s.k IS NULL THEN 'page_only' ELSE 'both' END AS origin, CASE WHEN p.k IS NOT NULL THEN true WHEN s.k % 11 <> 0 THEN false END AS displayed,
CASE WHEN s.k IS NULL THEN 'unknown' ELSE 'active' END AS presence, CASE WHEN p.k IS NOT NULL OR s.k % 11 <> 0 THEN {_NOW} END AS display_reconciled_at, false AS reclassified FROM s FULL JOIN p ON s.k = p.k AND s.n = p.n""")
def s20_reconcile_records(t: Tables) -> DataFrame:
    return _reconciled(t)[0]


@query(f"WITH {_TODO} SELECT bill_id, CASE WHEN bill_id % 11 <> 0 AND bill_id IN (SELECT bill_id FROM todo) AND bill_id IN (SELECT l_orderkey FROM lineitem) THEN {_NOW} END AS resolved_at FROM bill WHERE source_presence <> 'active'")
def s20_reconcile_ledger(t: Tables) -> DataFrame:
    return _reconciled(t)[1]


@query("""SELECT user_id, event_id AS at, CAST(place AS INT) AS n FROM (SELECT user_id, event_id, f, row_number() OVER (PARTITION BY user_id, island, f ORDER BY event_id) AS place
FROM (SELECT user_id, event_id, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, event_type IN ('error', 'signup', 'view') AS f FROM events))) WHERE f AND place >= 3""")
def s4_streaming_streaks(t: Tables) -> DataFrame:
    """A pattern, since a stream of files takes a folder or a pattern and the table may be one file."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]")
    failed = events.select("user_id", "event_id", C("event_type").isin("error", "signup", "view").alias("failed"))
    return loads.outage_streaks(failed, "user_id", "event_id", "failed")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s3_stream_dedupe(t: Tables) -> DataFrame:
    """Every event is delivered twice; the stream counts it once."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]").select("event_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    twice = events.withColumn("delivery", F.explode(F.sequence(F.lit(1), F.lit(2))))
    return loads.run_available(loads.deduplicated(twice, "event_id", "ts"), "dedupe").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderkey // 4000) AS n_items FROM orders")
def a1_read_pages(t: Tables) -> DataFrame:
    """Orders landed as one JSON page for each 4,000 keys, of three envelope shapes, and read back."""
    landing = loads.shared_folder(t.spark, "pages")
    items = t.orders.groupBy(F.floor(C("o_orderkey") / 4000).alias("page")).agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("items"))
    link = F.concat(F.lit("page-"), C("page") + 1)
    plain, nested = F.to_json(F.struct(C("items").alias("value"), link.alias("nextLink"))), F.to_json(F.struct(F.struct(C("items").alias("results"), link.alias("__next")).alias("d")))
    body = F.when(C("page") % 3 == 0, plain).when(C("page") % 3 == 1, nested).otherwise(F.to_json(F.struct(C("items").alias("d"))))
    items.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(landing)
    rows, found = pages.read_pages(t.spark, landing, "o_orderkey bigint, o_orderstatus string")
    return rows.join(found.where("error is null"), "file").select("item.o_orderkey", "item.o_orderstatus", C("n_items").cast("long").alias("n_items"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'late' ELSE event_type END AS event_type FROM events")
def s2_incremental_load(t: Tables) -> DataFrame:
    """Events landed and loaded, then a third of them delivered again with another type, and one of them unchanged."""
    root = loads.shared_folder(t.spark, "load")
    events = t.events.select("event_id", "user_id", "event_type")
    again = events.where("event_id % 3 = 0").withColumn("event_type", F.lit("late")).union(events.where("event_id = 1"))
    for delivery in (events, again):
        delivery.write.mode("append").json(f"{root}/landing")
        loads.incremental_load(t.spark, f"{root}/landing", events.schema.simpleString()[7:-1].replace(":", " "), ["event_id"], f"{root}/snapshots", f"{root}/offsets").awaitTermination()
    return loads.latest_snapshot(t.spark, f"{root}/snapshots")


@query("SELECT doc_key, CASE WHEN x LIKE '-%' OR x LIKE ' =%' THEN concat(chr(39), x) ELSE x END AS cell, CAST(bill_id AS VARCHAR) AS bill FROM (SELECT doc_key, bill_id, CASE CAST(bill_id % 4 AS INT) WHEN 0 THEN concat('-', source_id) WHEN 1 THEN concat(' =', chr(34), source_id, ',') WHEN 2 THEN '-' ELSE document_kind END AS x, bill_id % 4 = 2 AS none FROM doc) WHERE NOT none UNION ALL SELECT doc_key, CAST(NULL AS VARCHAR), CAST(bill_id AS VARCHAR) FROM doc WHERE bill_id % 4 = 2")
def a12_csv_export(t: Tables) -> DataFrame:
    """Documents written as an audit CSV in the shared folder and read back."""
    path = loads.shared_folder(t.spark, "export")
    raw = F.when(C("bill_id") % 4 == 0, F.concat(F.lit("-"), C("source_id"))).when(C("bill_id") % 4 == 1, F.concat(F.lit(' ="'), C("source_id"), F.lit(","))).when(C("bill_id") % 4 == 3, C("document_kind"))
    exports.export_csv(t.doc.select("doc_key", raw.alias("cell"), C("bill_id").alias("bill")), path)
    read = t.spark.read.csv(path, header=True, lineSep="\r\n", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, schema="doc_key string, cell string, bill string", enforceSchema=True)
    return read


@query("SELECT event_type AS entity, event_id % 50 AS row_count, event_id % 9 = 0 AS failed FROM events")
def a14_append_fetches(t: Tables) -> DataFrame:
    """Fetch records appended to a ledger in two runs, without the columns that it does not allow."""
    path = loads.shared_folder(t.spark, "fetches")
    records = t.events.select(C("event_type").alias("entity"), (C("event_id") % 50).alias("row_count"), (C("event_id") % 9 == 0).alias("failed"), "props", "user_id")
    for half in (records.where("user_id % 2 = 0"), records.where("user_id % 2 <> 0")):
        exports.append_fetches(half, path, ["entity", "row_count", "failed"])
    return t.spark.read.parquet(path)


def _inventory_run(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    bill = t.bill.select("bill_id", "session_key", "measure_prefix", "bill_title", "source_modified_at")
    target, landed = bill.where("bill_id % 10 <> 3"), bill.where("bill_id % 10 <> 7").withColumn("bill_title", F.when(C("bill_id") % 7 == 0, "changed").otherwise(C("bill_title")))
    states = target.select("bill_id", F.lit("active").alias("presence"), F.lit(None).cast("timestamp").alias("missing_since"))
    year = F.substring("session_key", 1, 4).cast("int")
    cursor = F.when(year % 2 == 0, F.to_timestamp(F.concat(year, F.lit("-07-01"))))
    sync = t.sess.select("session_key", F.lit("Measures").alias("entity"), cursor.alias("cursor"), F.lit(False).alias("complete"), F.lit("old").alias("last_error"))
    failures = t.sess.where(year % 5 == 0).select("session_key", F.lit("timeout").alias("error"))
    return jobs.inventory_run(target, states, landed, sync, failures, "bill_id", ["HB", "SB"], "source_modified_at", F.lit("2024-06-01 00:00:00").cast("timestamp"))


_RUN = """w AS (SELECT *, CAST(substr(session_key, 1, 4) AS INT) AS y FROM bill WHERE measure_prefix IN ('HB', 'SB')), p AS (SELECT *, y % 2 = 1 AS whole, CASE WHEN y % 2 = 0 THEN CAST(concat(y, '-07-01') AS TIMESTAMP) END AS cur FROM w WHERE y % 5 > 0),
o AS (SELECT * FROM p WHERE bill_id % 10 <> 3), n AS (SELECT * FROM p WHERE bill_id % 10 <> 7 AND (whole OR source_modified_at >= cur))"""


@query(f"WITH {_RUN} SELECT coalesce(o.bill_id, n.bill_id) AS bill_id, CASE WHEN n.bill_id IS NULL AND o.whole THEN 'missing' ELSE 'active' END AS presence, CASE WHEN o.bill_id IS NULL THEN 'new' WHEN n.bill_id IS NULL AND o.whole THEN 'became_missing' ELSE 'unchanged' END AS transition FROM o FULL JOIN n ON o.bill_id = n.bill_id")
def r11_inventory_presence(t: Tables) -> DataFrame:
    return _inventory_run(t)[1].select("bill_id", "presence", "transition")


@query(f"WITH {_RUN}, o2 AS (SELECT bill_id, bill_title FROM bill WHERE bill_id % 10 <> 3) SELECT coalesce(o2.bill_id, n.bill_id) AS bill_id, CASE WHEN n.bill_id IS NULL THEN o2.bill_title WHEN n.bill_id % 7 = 0 THEN 'changed' ELSE n.bill_title END AS bill_title FROM o2 FULL JOIN n ON o2.bill_id = n.bill_id")
def r11_inventory_rows(t: Tables) -> DataFrame:
    return _inventory_run(t)[0].select("bill_id", "bill_title")


@query(f"WITH {_RUN} SELECT session_key, 'Measures' AS entity, CASE WHEN y % 5 = 0 THEN CASE WHEN y % 2 = 0 THEN CAST(concat(y, '-07-01') AS TIMESTAMP) END ELSE (SELECT max(source_modified_at) FROM n WHERE n.session_key = s.session_key) END AS cursor, y % 5 > 0 AS complete, CASE WHEN y % 5 = 0 THEN 'timeout' END AS last_error FROM (SELECT session_key, CAST(substr(session_key, 1, 4) AS INT) AS y FROM sess) s")
def r11_inventory_sync(t: Tables) -> DataFrame:
    return _inventory_run(t)[2]


@query("""SELECT bill_id, bill_title, sponsors, total FROM (SELECT b.bill_id, bill_title, sponsors, count(*) OVER () AS total, row_number() OVER (ORDER BY session_key NULLS FIRST, measure_prefix NULLS FIRST, CAST(measure_number AS BIGINT) NULLS FIRST, b.bill_id) AS r FROM bill b JOIN (SELECT l_orderkey, string_agg(concat('S', l_suppkey), ', ' ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN 2147483647 ELSE l_linenumber END, l_suppkey, l_partkey) AS sponsors, bool_or(concat('S', l_suppkey) LIKE '%7%') AS hit FROM lineitem GROUP BY 1) s ON s.l_orderkey = b.bill_id WHERE hit AND bill_chamber = 'Senate') WHERE r <= 100""")
def r1_bills_by_sponsor(t: Tables) -> DataFrame:
    sponsors = t.lineitem.select(C("l_orderkey").alias("bill_id"), F.concat(F.lit("S"), "l_suppkey").alias("sponsor_name"), F.when(C("l_linenumber") % 2 != 0, C("l_linenumber")).alias("print_order"), "l_suppkey", "l_partkey")
    found = searches.bills_by_sponsor(filters.bill_search(t.bill, chamber="Senate"), sponsors, "7")
    top = paging.with_total(paging.page(found, paging.bill_order("bill", False), 100), found)
    entries = F.sort_array(F.collect_list(F.struct(F.coalesce("print_order", F.lit(2147483647)), "l_suppkey", "l_partkey", "sponsor_name")))
    names = sponsors.join(top.select("bill_id"), "bill_id", "left_semi").groupBy("bill_id").agg(F.array_join(F.transform(entries, lambda x: x["sponsor_name"]), ", ").alias("sponsors"))
    return top.join(names, "bill_id").select("bill_id", "bill_title", "sponsors", "total")


@query("""SELECT d.doc_key, d.session_key, document_kind, committee_name, submitter, CASE WHEN displayed IS NULL THEN 'unknown' WHEN displayed THEN 'yes' ELSE 'no' END AS displayed, content_length FROM wdoc d LEFT JOIN (SELECT doc_key, max(content_length) AS content_length FROM probe GROUP BY 1) p ON p.doc_key = d.doc_key WHERE (lower(committee_code) LIKE '%of o%' OR lower(committee_name) LIKE '%of o%') AND source_presence = 'active'""")
def r2_document_export(t: Tables) -> DataFrame:
    sizes = t.probe.groupBy("doc_key").agg(F.max("content_length").alias("content_length"))
    found = searches.documents(t.wdoc, committee="of o", presence="active").join(sizes, "doc_key", "left")
    return found.select("doc_key", "session_key", "document_kind", "committee_name", "submitter", X.yes_no_unknown(C("displayed")).alias("displayed"), "content_length")
