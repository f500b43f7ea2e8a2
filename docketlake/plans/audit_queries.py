"""Queries of packages, source contracts, routes, canonical JSON, frozen lists, download states and both page families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions import routes
from docketlake.functions import text as X
from docketlake.operators import archive, display, merge
from docketlake.plans.registry import query
from docketlake.plans.standins import Tables
from docketlake.sources import contract, payloads
from docketlake.streaming.loads import shared_folder

C = F.col
_NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def _now() -> Column:
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _little(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def stored_package(members: list[tuple[Column, Column]]) -> Column:
    """Bytes of a ZIP file that stores (name, text) members without compression."""
    local, central, at = [], [], F.lit(0)
    for name, text in members:
        data = text.cast("binary")
        sizes = F.concat(_little(F.crc32(data), 4), _little(F.octet_length(data), 4), _little(F.octet_length(data), 4), _little(F.octet_length(name), 2), F.unhex(F.lit("0000")))
        head = F.concat(F.unhex(F.lit("504B03040A000008000000000000")), sizes, name.cast("binary"), data)
        central.append(F.concat(F.unhex(F.lit("504B010214000A000008000000000000")), sizes, F.unhex(F.lit("0000000000000000 0000".replace(" ", ""))), _little(at, 4), name.cast("binary")))
        local.append(head)
        at = at + F.octet_length(head)
    body = F.concat(*central)
    return F.concat(*local, body, F.unhex(F.lit("504B050600000000")), _little(F.lit(len(members)), 2), _little(F.lit(len(members)), 2), _little(F.octet_length(body), 4), _little(at, 4), F.unhex(F.lit("0000")))


@query("""SELECT doc_id, CASE WHEN source = 'src3' THEN 'zip' WHEN lang = 'en' THEN 'docx' WHEN lang = 'de' THEN CASE WHEN n_chars % 2 = 0 THEN 'xlsm' ELSE 'xlsx' END WHEN lang = 'fr' THEN 'pptx' ELSE 'zip' END AS type, CASE WHEN source = 'src3' THEN 'unsafe_path' WHEN source = 'src5' THEN 'hash_mismatch' ELSE 'valid' END AS verdict,
CASE WHEN source IN ('src3', 'src5') OR lang = 'en' THEN NULL ELSE concat('declared application/vnd.openxmlformats-officedocument.wordprocessingml.document, found ', CASE WHEN lang = 'de' THEN CASE WHEN n_chars % 2 = 0 THEN 'application/vnd.ms-excel.sheet.macroenabled.12' ELSE 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' END WHEN lang = 'fr' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' ELSE 'application/zip' END) END AS note FROM documents""")
def a11_packages(t: Tables) -> DataFrame:
    """Each document packed as an Office file of its language, and judged by what the package holds."""
    kind = F.when(C("lang") == "en", "word/document.xml").when(C("lang") == "de", "xl/workbook.xml").when(C("lang") == "fr", "ppt/presentation.xml").otherwise("notes.txt")
    other = F.when(C("source") == "src3", "a/../../b").when(C("n_chars") % 2 == 0, "xl/vbaProject.bin").otherwise("[Content_Types].xml")
    path = C("doc_id").cast("string").alias("path")
    rows = t.documents.select(path, stored_package([(kind, F.coalesce("text", F.lit(""))), (other, C("doc_id").cast("string"))]).alias("content"), F.lit(payloads.MIMES["docx"]).alias("declared_mime"))
    folder = shared_folder(t.spark, "packages")
    rows.write.parquet(folder)
    rows = t.spark.read.parquet(folder)
    expected = t.documents.where("source = 'src5'").select(path, F.lit(None).cast("bigint").alias("expected_length"), F.lit(None).cast("string").alias("expected_mime"), F.sha2("text", 256).alias("expected_sha256"))
    return payloads.validate_files(rows, expected).select(C("path").cast("bigint").alias("doc_id"), "type", "verdict", "note")


_GROUPS = "SELECT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, max(coalesce(text, '')) AS body FROM {documents} GROUP BY 1, 2"


@query(f"SELECT source, lang, CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'rtf' WHEN 'fr' THEN 'html' ELSE 'txt' END AS type, CASE lang WHEN 'en' THEN 'valid' WHEN 'de' THEN CASE WHEN source < 'src3' THEN 'length_mismatch' ELSE 'valid' END WHEN 'fr' THEN 'html' ELSE 'no_signature' END AS verdict, octet_length(encode(body)) > 0 AS filled FROM ({_GROUPS.format(documents='documents')})")
def a10_landed_files(t: Tables) -> DataFrame:
    """The longest text of each source and language landed as a file, and the files read back and judged."""
    folder = shared_folder(t.spark, "payloads")
    start = F.when(C("lang") == "en", "%PDF-1.4 ").when(C("lang") == "de", "{\\rtf1 ").when(C("lang") == "fr", "<html><body>").otherwise("~ ")
    groups = t.sql(_GROUPS)
    groups.select(C("source").alias("s"), C("lang").alias("l"), F.concat(start, F.regexp_replace("body", "%%EOF", ""), F.when(C("lang") == "en", "%%EOF").otherwise("")).alias("value")).write.partitionBy("s", "l").text(folder)
    part = lambda name: F.regexp_extract("path", rf"/{name}=([^/]*)/", 1)
    files = payloads.scan(t.spark, folder).withColumn("logical_name", F.concat(part("s"), F.lit(".txt")))
    short = files.where((part("l") == "de") & (part("s") < "src3")).select("path", F.lit(1).cast("bigint").alias("expected_length"), F.lit(None).cast("string").alias("expected_mime"), F.lit(None).cast("string").alias("expected_sha256"))
    found = payloads.validate_files(files.select("path", "content", "logical_name"), short).select(part("s").alias("source"), part("l").alias("lang"), "type", "verdict")
    return found.join(groups.select("source", "lang", (F.octet_length("body") > 0).alias("filled")), ["source", "lang"])


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation), c AS (SELECT c_custkey AS id, CAST(c_custkey % 5 AS INT) AS m FROM customer),
r AS (SELECT unnest(['Bills', 'Bills', 'Bills', 'People']) AS entity, unnest(['Key', 'Title', 'Date', 'Name']) AS property)
SELECT id, finding, entity, property, true AS material FROM (SELECT id, 'metadata_parse_error' AS finding, '$metadata' AS entity, CAST(NULL AS VARCHAR) AS property FROM c WHERE m = 4
UNION ALL SELECT id, 'missing_entity_set', 'People', NULL FROM c WHERE m = 1 UNION ALL SELECT id, 'missing_property', entity, property FROM c, r WHERE m = 2 AND property IN ('Title', 'Date') UNION ALL SELECT id, 'missing_property', entity, property FROM c, r WHERE m = 3 AND property = 'Name')""")
def a9_metadata_contract(t: Tables) -> DataFrame:
    """A metadata document for each customer, from whole to broken."""
    m = C("c_custkey") % 5
    prop = lambda name: F.lit(f'<Property Name="{name}" Type="Edm.String"/>')
    bills = F.concat(F.lit('<EntityType Name="Bill"><Key><PropertyRef Name="Title"/></Key>'), prop("Key"), F.when(m == 2, "").otherwise(F.concat(prop("Title"), prop("Date"))), F.lit("</EntityType>"))
    people = F.concat(F.lit('<EntityType Name="Person">'), F.when(m == 3, "").otherwise(prop("Name")), F.lit("</EntityType>"))
    sets = F.concat(F.lit('<EntityContainer Name="C"><EntitySet Name="Bills" EntityType="M.Bill"/>'), F.when(m == 1, "").otherwise('<EntitySet Name="People" EntityType="M.Person"/>'), F.lit("</EntityContainer>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><edmx:Edmx Version="1.0" xmlns:edmx="urn:x"><edmx:DataServices><Schema Namespace="M" xmlns="urn:y">'), bills, people, F.lit("</Schema><Schema>"), sets, F.when(m == 4, "").otherwise("</Schema></edmx:DataServices></edmx:Edmx>"))
    return contract.report(t.customer.select(C("c_custkey").alias("id"), xml.alias("xml")), "id", "xml", {"Bills": "Key Title Date", "People": "Name"})


@query("""SELECT o_orderkey, concat('{"at":"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '","bill":{"a":["', o_custkey, '",null],"b":["', o_orderpriority, '"],"é":', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE concat('["', o_orderkey, '"]') END, '},"day":"', strftime(o_orderdate, '%Y-%m-%d'), '"}') AS json, CASE WHEN o_orderkey % 2 = 0 THEN concat('{"b": ', o_orderkey, ', "a":1}') ELSE concat('"a ', chr(92), '"', o_orderkey, chr(92), '""') END AS said FROM orders""")
def a16_canonical_nested(t: Tables) -> DataFrame:
    """Nested values whose maps stand in two orders, and text that is JSON or not."""
    a, b, e = F.array(C("o_custkey").cast("string"), F.lit(None).cast("string")), F.array("o_orderpriority"), F.when(C("o_orderkey") % 3 > 0, F.array(C("o_orderkey").cast("string")))
    bill = F.when(C("o_orderkey") % 2 == 0, F.create_map(F.lit("é"), e, F.lit("b"), b, F.lit("a"), a)).otherwise(F.create_map(F.lit("a"), a, F.lit("é"), e, F.lit("b"), b))
    value = F.struct(C("o_orderdate").cast("date").alias("day"), bill.alias("bill"), C("o_orderdate").cast("timestamp").alias("at"))
    said = F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit('{"b": '), "o_orderkey", F.lit(', "a":1}'))).otherwise(F.concat(F.lit('a "'), "o_orderkey", F.lit('"')))
    return t.orders.select("o_orderkey", X.canonical_value(value).alias("json"), X.canonical_text(said).alias("said"))


_PATHS = ["/liz/2021R1/Downloads/PublicTestimonyDocument/{n}", "/liz/2021r1/x/../Downloads//CommitteeMeetingDocument/./{n}/", "/liz%252F2021R1%2FDownloads%5CPublicTestimonyDocument/{n}?a=/b#c", "/liz/2021R1/Downloads/PublicTestimonyDocument/{n}x", "/liz/2021R1/Overview/{n}", "/liz/2021R1/Downloads/PublicTestimonyDocument/%25252531", "/liz/2021R1/Downloads/PublicTestimonyDocument/{n}%00"]
_HOSTS = ["https://Pages.Example.org.:443", "", "http://pages.example.org", "https://u@pages.example.org", "https://pages.example.org:8443"]


@query("""SELECT event_id, CASE WHEN p IN (0, 1, 2) AND h < 2 THEN '2021R1' END AS session, CASE WHEN p IN (0, 1, 2) AND h < 2 THEN CASE WHEN p = 1 THEN 'committeemeetingdocument' ELSE 'publictestimonydocument' END END AS family, CASE WHEN p IN (0, 1, 2) AND h < 2 THEN CAST(event_id AS VARCHAR) END AS id,
CASE WHEN p = 6 THEN 'null_byte' WHEN p IN (3, 5) THEN 'not_canonical' WHEN p = 4 THEN 'no_route' WHEN h >= 2 THEN 'untrusted' END AS problem FROM (SELECT event_id, CAST(event_id % 7 AS INT) AS p, CAST(event_id % 5 AS INT) AS h FROM events)""")
def b21_routes(t: Tables) -> DataFrame:
    """Download URLs that are encoded, dotted or elsewhere, for each event."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    url = F.concat(pick(_HOSTS, C("event_id") % 5), F.replace(pick(_PATHS, C("event_id") % 7), F.lit("{n}"), C("event_id").cast("string")))
    return t.events.select("event_id", routes.download_route(url, "pages.example.org").alias("r")).select("event_id", "r.*")


@query("""WITH p AS (SELECT c_custkey AS k, concat('s/', c_nationkey, '/', CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'File.PDF' WHEN 1 THEN 'file.pdf' WHEN 2 THEN 'ﬁle.pdf' ELSE concat('own', c_custkey) END) AS path, c_nationkey AS n, c_custkey % 4 < 3 AS shared FROM customer)
SELECT concat('s/', n, '/file.pdf') AS folded, CASE WHEN count(DISTINCT path) > 1 THEN 'folded' ELSE 'same' END AS level, count(*) AS n, list_sort(list(DISTINCT path)) AS paths FROM p WHERE shared GROUP BY p.n HAVING count(*) > 1""")
def b20_collisions(t: Tables) -> DataFrame:
    k = C("c_custkey") % 4
    name = F.when(k == 0, "File.PDF").when(k == 1, "file.pdf").when(k == 2, "ﬁle.pdf").otherwise(F.concat(F.lit("own"), "c_custkey"))
    plan = t.customer.select(C("c_custkey").alias("doc_key"), F.concat(F.lit("s/"), "c_nationkey", F.lit("/"), name).alias("path"))
    return routes.path_collisions(plan)


@query("SELECT session_key, item_key, position FROM (SELECT session_key, item_key, row_number() OVER (ORDER BY session_key, item_key) - 1 AS position FROM (SELECT DISTINCT session_key, doc_key AS item_key FROM doc d JOIN bill b ON d.bill_id = b.bill_id WHERE download_status IN ('failed_retryable', 'failed_terminal') AND document_kind IN ('public_testimony', 'committee_presentation', 'floor_letter') AND trim(coalesce(canonical_download_url, '')) <> '' AND d.source_id % 2 = 1))")
def s21_frozen_list(t: Tables) -> DataFrame:
    """The failures of a run, frozen as the list of the next, which a second attempt leaves alone; its pages side by side."""
    items = t.doc.where("source_id % 2 = 1").select(F.lit("document").alias("item_type"), C("doc_key").alias("item_key"))
    root = shared_folder(t.spark, "lists")
    found = archive.retry_items(7, t.doc, t.bill, 1990, True, items)
    archive.publish_list(found, ["session_key", "item_key"], root, 7)
    archive.publish_list(found.limit(1), ["session_key", "item_key"], root, 7)
    pages = archive.listed(t.spark, root, 7, size=1000).union(archive.listed(t.spark, root, 7, after=999))
    return pages.select("session_key", "item_key", "position")


_CODE = "CASE CAST(bill_id % 7 AS int) WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_404' WHEN 2 THEN 'ok' WHEN 3 THEN 'low_space' WHEN 4 THEN 'validation_failed' WHEN 5 THEN 'content_length_mismatch' END"


@query(f"""WITH d AS (SELECT doc_key, max(bill_id) AS bill_id, max(download_status) AS s, max(source_id) AS n FROM doc GROUP BY 1), x AS (SELECT *, {_CODE} AS code, s = 'downloaded' AND n % 3 > 0 AS valid, bill_id % 6 = 0 AS changed FROM d),
y AS (SELECT *, valid AND NOT changed AS skip, s = 'failed_terminal' AND bill_id % 2 = 0 AS keep FROM x WHERE true), z AS (SELECT *, NOT skip AND s = 'failed_terminal' AS pre FROM y)
SELECT doc_key, CASE WHEN skip OR pre THEN NULL WHEN s = 'downloaded' THEN CASE WHEN valid THEN 'changed_remote' ELSE 'missing_local' END ELSE s END AS queued_from, CASE WHEN skip OR pre THEN s WHEN code IS NULL THEN 'queued' WHEN code = 'ok' THEN 'downloaded' WHEN code = 'low_space' THEN 'paused_low_space' WHEN code IN ('timeout', 'content_length_mismatch') THEN 'failed_retryable' ELSE 'failed_terminal' END AS status,
CASE WHEN skip OR pre OR code IS NULL THEN 'not_validated' WHEN code = 'ok' THEN 'valid' WHEN code IN ('validation_failed', 'content_length_mismatch') THEN 'invalid' ELSE 'not_validated' END AS validation_status,
CASE WHEN skip THEN 'skipped' WHEN pre THEN 'failed_terminal' WHEN code IS NULL THEN 'queued' WHEN code = 'ok' THEN 'completed' WHEN code = 'low_space' THEN 'paused_low_space' WHEN code IN ('timeout', 'content_length_mismatch') THEN 'failed_retryable' ELSE 'failed_terminal' END AS item_status,
CASE WHEN skip THEN NULL WHEN pre THEN concat('old ', n) WHEN code <> 'ok' THEN concat('last ', code) END AS error, pre AS preserved FROM z""")
def s27_download_states(t: Tables) -> DataFrame:
    """Two attempts at each document but some, of which the second decides."""
    docs = t.doc.groupBy("doc_key").agg(F.max("bill_id").alias("bill_id"), F.max("download_status").alias("download_status"), F.max("source_id").alias("n"))
    code = F.expr(_CODE)
    tried = docs.select("doc_key", "bill_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).withColumn("c", code).where("c is not null")
    attempts = tried.select("doc_key", "attempt", ((C("attempt") == 2) & (C("c") == "ok")).alias("ok"), F.when(C("attempt") == 1, "timeout").otherwise(C("c")).alias("code"), ((C("attempt") == 1) | C("c").isin("timeout", "content_length_mismatch")).alias("retryable"), F.concat(F.when(C("attempt") == 1, "first ").otherwise("last "), "c").alias("message"))
    state = docs.select("doc_key", "download_status", F.lit("not_validated").alias("validation_status"), ((C("download_status") == "downloaded") & (C("n") % 3 > 0)).alias("file_valid"), (C("bill_id") % 6 == 0).alias("source_changed"), F.concat(F.lit("old "), "n").alias("last_error"))
    return archive.download_states(state, attempts, False)


@query(f"SELECT coalesce(b.k, a.k) AS k, CASE WHEN a.k IS NOT NULL THEN 'active' WHEN b.k % 4 = 0 THEN 'unknown' ELSE 'missing' END AS presence, CASE WHEN a.k IS NULL AND b.k % 4 > 0 THEN {_NOW} END AS missing_since, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL AND b.k % 4 > 0 THEN 'became_missing' ELSE 'unchanged' END AS transition FROM before b FULL JOIN after a ON a.k = b.k")
def s5_page_only_exempt(t: Tables) -> DataFrame:
    known = t.before.select("k", F.when(C("k") % 4 == 0, "unknown").otherwise("active").alias("presence"), F.lit(None).cast("timestamp").alias("missing_since"), F.when(C("k") % 4 == 0, "page_only").otherwise("both").alias("origin"))
    return merge.presence(known, t.after, "k", True, _now(), exempt=C("origin") == "page_only").select("k", "presence", "missing_since", "transition")


_FAMILY = "CASE WHEN l_returnflag = 'A' THEN 'committeemeetingdocument' ELSE 'publictestimonydocument' END"
_LINES = f"SELECT DISTINCT l_orderkey AS b, {_FAMILY} AS f, CAST(l_linenumber AS BIGINT) AS n FROM lineitem"
_STATUS = "CASE WHEN b % 5 = 4 THEN 'not_applicable' WHEN b % 7 = 3 THEN 'checked_zero' WHEN b % 9 = 5 THEN 'failed_fetch' WHEN b % 11 = 0 THEN 'parser_anomalous' WHEN EXISTS (SELECT 1 FROM l WHERE l.b = x.b AND n % 3 <> 0) THEN 'checked_with_records' ELSE 'checked_zero' END"
_RECON = f"""l AS ({_LINES}), x AS (SELECT bill_id AS b, session_key FROM bill), st AS (SELECT b, session_key, {_STATUS} AS status, b % 5 < 4 AND b % 7 <> 3 AS now_ FROM x),
s AS (SELECT DISTINCT b, f, n, f LIKE 'public%' OR n % 2 = 0 AS expected FROM l WHERE n % 4 <> 1 AND b IN (SELECT b FROM st WHERE now_)), p AS (SELECT l.* FROM l JOIN st ON st.b = l.b WHERE now_ AND status = 'checked_with_records' AND n % 3 <> 0),
r AS (SELECT coalesce(s.b, p.b) AS b, coalesce(s.f, p.f) AS f, coalesce(s.n, p.n) AS n, s.b IS NOT NULL AS ins, p.b IS NOT NULL AS onp, expected FROM s FULL JOIN p ON s.b = p.b AND s.f = p.f AND s.n = p.n),
rr AS (SELECT r.*, st.status, st.status LIKE 'checked%' AS proof FROM r JOIN st ON st.b = r.b),
new AS (SELECT b, f, CASE WHEN ins AND NOT onp AND expected THEN 'source_only' WHEN NOT ins THEN 'page_only' WHEN ins AND onp AND NOT expected THEN 'displayed_other_type' END AS a, n FROM rr WHERE proof
 UNION ALL SELECT b, f, 'count_mismatch', NULL FROM rr WHERE proof GROUP BY b, f HAVING count(*) FILTER (ins AND expected) <> count(*) FILTER (onp)), fnd AS (SELECT * FROM new WHERE a IS NOT NULL),
old AS (SELECT bill_id AS b, 'publictestimonydocument' AS f, CASE WHEN bill_id % 2 = 0 THEN 'source_only' ELSE 'type_drift' END AS a, CAST(2 AS BIGINT) AS n FROM bill WHERE source_presence <> 'active'),
led AS (SELECT coalesce(o.b, w.b) AS b, coalesce(o.f, w.f) AS f, coalesce(o.a, w.a) AS a, CASE WHEN o.b IS NULL THEN w.n ELSE o.n END AS n, CASE WHEN o.b IS NULL THEN 0 ELSE 3 END + CASE WHEN w.b IS NULL THEN 0 ELSE 1 END AS k, w.b IS NULL AND o.a = 'source_only' AND (SELECT (status LIKE 'checked%' AND now_) OR status = 'not_applicable' FROM st WHERE st.b = o.b) AS done FROM old o FULL JOIN fnd w ON o.b = w.b AND o.f = w.f AND o.a = w.a AND o.n IS NOT DISTINCT FROM w.n)"""


@query(f"""WITH {_RECON} SELECT 'records' AS frame, concat_ws('/', b, f, n) AS key, concat_ws('|', CASE WHEN ins AND onp THEN 'both' WHEN ins THEN 'source_only' ELSE 'page_only' END, CASE WHEN onp THEN 'true' WHEN proof THEN 'false' ELSE 'null' END, CASE WHEN ins THEN 'active' ELSE 'unknown' END, CASE WHEN ins AND onp AND NOT expected THEN 'true' ELSE 'false' END) AS value FROM rr
UNION ALL SELECT 'checks', concat_ws('/', b, fam), status FROM st, (SELECT unnest(['publictestimonydocument', 'committeemeetingdocument']) AS fam)
UNION ALL SELECT 'ledger', concat_ws('/', b, f, a, n), concat_ws('|', k, CASE WHEN done THEN 'resolved' ELSE 'open' END) FROM led
UNION ALL SELECT 'sessions', session_key, CASE min(CASE status WHEN 'failed_fetch' THEN 1 WHEN 'parser_anomalous' THEN 2 WHEN 'checked_with_records' THEN 3 WHEN 'checked_zero' THEN 4 ELSE 5 END) WHEN 1 THEN 'failed_fetch' WHEN 2 THEN 'parser_anomalous' WHEN 3 THEN 'checked_with_records' WHEN 4 THEN 'checked_zero' ELSE 'not_applicable' END FROM st GROUP BY session_key""")
def s20_both_families(t: Tables) -> DataFrame:
    """Pages with both families of every bill: some cannot be fetched or read, some were checked before, some are no candidates; every frame as (frame, key, value)."""
    b = C("bill_id")
    lines = t.lineitem.select(C("l_orderkey").alias("bill_id"), F.expr(_FAMILY).alias("family"), C("l_linenumber").cast("bigint").alias("source_id")).distinct()
    row = F.concat(F.lit("<tr><td><a href='/Downloads/"), "family", F.lit("/"), "source_id", F.lit("'>x "), "source_id", F.lit("</a></td></tr>"))
    table = F.concat(F.lit("<h2>Testimony</h2><table><tr><th>Title</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>"))
    full = lines.where("source_id % 3 <> 0 and bill_id % 11 <> 0").groupBy("bill_id").agg(table.alias("html"))
    empty = F.when(b % 11 == 0, "<h2>Testimony</h2>").otherwise("<h2>Testimony</h2><p>No items to display.</p>")
    pages = t.bill.select("bill_id").join(full, "bill_id", "left").select(C("bill_id").alias("page_id"), F.coalesce("html", empty).alias("html"))
    source = lines.where("source_id % 4 <> 1").withColumn("expected", C("family").startswith("public") | (C("source_id") % 2 == 0))
    reasons, reuse = t.bill.where(b % 5 < 4).select("bill_id"), t.bill.where(b % 7 == 3).select("bill_id", F.lit("checked_zero").alias("status"))
    ledger = t.bill.where("source_presence <> 'active'").select("bill_id", F.lit(display.TESTIMONY).alias("family"), F.when(b % 2 == 0, "source_only").otherwise("type_drift").alias("anomaly_type"), F.lit(2).cast("bigint").alias("source_id"), F.lit(3).cast("bigint").alias("occurrences"), F.lit(None).cast("timestamp").alias("resolved_at"))
    out = display.reconcile_families(t.bill.select("bill_id", "session_key"), source, pages, t.bill.where(b % 9 == 5), reasons, reuse, ledger, _now())
    frame = lambda name, key, value: out[name].select(F.lit(name).alias("frame"), key.alias("key"), value.alias("value"))
    text = lambda c: F.coalesce(C(c).cast("string"), F.lit("null"))
    record = frame("records", F.concat_ws("/", "bill_id", "family", "source_id"), F.concat_ws("|", "origin", text("displayed"), "presence", text("reclassified")))
    checks = frame("checks", F.concat_ws("/", "bill_id", "family"), C("status"))
    found = frame("ledger", F.concat_ws("/", "bill_id", "family", "anomaly_type", "source_id"), F.concat_ws("|", "occurrences", F.when(C("resolved_at").isNull(), "open").otherwise("resolved")))
    return record.union(checks).union(found).union(frame("sessions", C("session_key"), C("display_status")))
