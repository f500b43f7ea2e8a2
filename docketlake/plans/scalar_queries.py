"""Queries of the source, scalar and filter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions import records as R
from docketlake.functions import text as X
from docketlake.operators import filters
from docketlake.plans.registry import query
from docketlake.plans.standins import Tables
from docketlake.sources import html_tables, payloads
from docketlake.sources import pages as P

C = F.col


@query("""
SELECT url, finding, n FROM (
  SELECT coalesce(u.url, t.url) AS url, CASE WHEN u.url IS NULL THEN 'dangling' WHEN n > 1 THEN 'linked_twice' WHEN c > 1 THEN 'repeated_page' WHEN n IS NULL THEN 'unlinked' END AS finding, coalesce(n, 0) AS n
  FROM (SELECT concat(page_id, ' ', url) AS url, count(*) AS c FROM pages GROUP BY 1) u
  FULL JOIN (SELECT concat(q.page_id, ' ', q.url) AS url, count(*) AS n FROM pages p JOIN pages q ON q.page_id = CASE WHEN p.page_id % 40 = 5 THEN p.page_id - 3 ELSE p.page_id + 1 END GROUP BY 1) t ON u.url = t.url) x
WHERE finding IS NOT NULL""")
def a2_page_chain(t: Tables) -> DataFrame:
    """Reads of 40 pages each, whose last page links back into its own read."""
    name = F.concat(C("page_id"), F.lit(" "), C("url"))
    this = t.pages.select("page_id", name.alias("url"), F.when(C("page_id") % 40 == 5, C("page_id") - 3).otherwise(C("page_id") + 1).alias("next_id"), F.floor((C("page_id") - 6) / 40).alias("chain"))
    names = t.pages.select(C("page_id").alias("next_id"), name.alias("next_url"))
    return P.audit_page_chain(this.join(names, "next_id", "left"))


@query("SELECT bill_id, measure_prefix, source_modified_at FROM bill WHERE session_key = '1995R1' AND measure_prefix IN ('HB', 'SB', 'HJR') AND source_modified_at >= TIMESTAMP '1995-07-01'")
def a3_scoped_read(t: Tables) -> DataFrame:
    return P.scoped_read(t.bill, "1995R1", ["HB", "SB", "HJR"], "1995-07-01", "source_modified_at")[0].select("bill_id", "measure_prefix", "source_modified_at")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN session_key <> '1995R1' THEN 'session' WHEN measure_prefix NOT IN ('HB', 'SB') THEN 'prefix' END AS reason FROM bill) WHERE reason IS NOT NULL GROUP BY 1")
def a4_scope_guard(t: Tables) -> DataFrame:
    return P.scope_violations(t.bill, "1995R1", ["HB", "SB"])


@query("""
WITH cat AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN concat(' 20', lpad(CAST(o_custkey % 90 + 10 AS VARCHAR), 2, '0'), ' r1') WHEN o_custkey % 7 = 1 THEN '' ELSE concat('19', o_custkey % 90 + 10, 'R1') END AS session_key,
  CASE WHEN o_custkey % 5 = 0 THEN 'soon' WHEN o_custkey % 5 = 1 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS begin_date FROM orders),
keyed AS (SELECT *, CASE WHEN regexp_matches(upper(regexp_replace(session_key, '\\s+', '', 'g')), '^20[0-9]{2}[A-Z][A-Z0-9]{0,4}$') THEN upper(regexp_replace(session_key, '\\s+', '', 'g')) END AS normal_key, try_cast(nullif(begin_date, '') AS TIMESTAMP) AS begin_at FROM cat)
SELECT session_key, begin_date, normal_key, begin_at, nullif(concat_ws('; ', CASE WHEN trim(session_key) = '' THEN 'no session key' WHEN normal_key IS NULL THEN 'session key is not in the modern format' END,
  CASE WHEN trim(begin_date) = '' THEN 'no begin date' WHEN begin_at IS NULL THEN 'begin date is not supported' END), '') AS compatibility_issue,
  CASE WHEN normal_key IS NOT NULL THEN count(*) OVER (PARTITION BY normal_key) END AS n_same FROM keyed""".replace("\\\\s", "\\s"))
def a5_catalogue(t: Tables) -> DataFrame:
    k = C("o_custkey")
    two = F.lpad((k % 90 + 10).cast("string"), 2, "0")
    key = F.when(k % 7 == 0, F.concat(F.lit(" 20"), two, F.lit(" r1"))).when(k % 7 == 1, "").otherwise(F.concat(F.lit("19"), two, F.lit("R1")))
    date = F.when(k % 5 == 0, "soon").when(k % 5 == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.resolve_catalogue(t.orders.select(key.alias("session_key"), date.alias("begin_date")))


@query("SELECT * FROM sess WHERE session_key BETWEEN '1995R1' AND '1996R1'")
def a6_select_range(t: Tables) -> DataFrame:
    return P.select_range(t.sess, "1995R1", "1996R1")


@query("""
WITH req AS (SELECT DISTINCT source AS entity, lang AS property FROM documents), act AS (SELECT DISTINCT source AS entity, lang AS property FROM documents WHERE n_chars >= 2000 AND source <> 'src3'),
miss AS (SELECT r.*, r.entity IN (SELECT entity FROM act) AS there FROM req r WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.entity = r.entity AND a.property = r.property))
SELECT entity, property, 'missing_property' AS finding FROM miss WHERE there UNION ALL SELECT DISTINCT entity, CAST(NULL AS VARCHAR), 'missing_entity_set' FROM miss WHERE NOT there""")
def a9_contract(t: Tables) -> DataFrame:
    required = t.documents.select(C("source").alias("entity"), C("lang").alias("property")).distinct()
    return P.check_contract(required, t.documents.where("n_chars >= 2000 and source <> 'src3'").select(C("source").alias("entity"), C("lang").alias("property")).distinct())


@query("SELECT doc_key, CASE WHEN x LIKE '-%' OR x LIKE ' =%' THEN concat('''', x) ELSE x END AS cell FROM (SELECT doc_key, CASE CAST(bill_id % 4 AS INT) WHEN 0 THEN concat('-', source_id) WHEN 1 THEN concat(' =', source_id) WHEN 2 THEN '' ELSE document_kind END AS x FROM doc)")
def a12_csv_cells(t: Tables) -> DataFrame:
    raw = F.when(C("bill_id") % 4 == 0, F.concat(F.lit("-"), C("source_id"))).when(C("bill_id") % 4 == 1, F.concat(F.lit(" ="), C("source_id"))).when(C("bill_id") % 4 == 3, C("document_kind"))
    return t.doc.select("doc_key", X.csv_safe(raw).alias("cell"))


@query("SELECT event_type AS entity, count(*) AS n_fetches, CAST(sum(event_id % 50) AS BIGINT) AS n_rows, count(*) FILTER (event_id % 9 = 0) AS n_failed FROM events GROUP BY 1")
def a14_fetch_ledger(t: Tables) -> DataFrame:
    fetches = P.project_allowed(t.events.select(C("event_type").alias("entity_set"), (C("event_id") % 50).alias("row_count"), (C("event_id") % 9 == 0).alias("failed"), "props"), {"entity_set": "entity"}, ["entity", "row_count", "failed"])
    return fetches.groupBy("entity").agg(F.count("*").alias("n_fetches"), F.sum("row_count").alias("n_rows"), F.count_if("failed").alias("n_failed"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def a15_content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT c_custkey, CAST(json_object('name', c_name, 'nation', c_nationkey, 'segment', c_mktsegment) AS VARCHAR) AS json FROM customer")
def a16_canonical_json(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.canonical_json({"segment": C("c_mktsegment"), "name": C("c_name"), "nation": C("c_nationkey")}).alias("json"))


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE concat('20', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), 'R1') END AS session_key FROM orders""")
def b1_session_key(t: Tables) -> DataFrame:
    k = C("o_orderkey")
    raw = F.when(k % 3 == 2, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit(" 20 "), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("r 1\n")))
    return t.orders.select("o_orderkey", R.session_key(raw).alias("session_key"))


@query("""SELECT bill_id, CASE WHEN bill_id < 1000000 AND bill_id % 5 <> 4 THEN measure_prefix END AS prefix, CASE WHEN bill_id < 1000000 AND bill_id % 5 <> 4 THEN measure_number END AS number,
CASE WHEN bill_id < 1000000 AND bill_id % 5 <> 4 THEN concat(measure_prefix, measure_number) END AS compact, CASE WHEN bill_id < 1000000 AND bill_id % 5 <> 4 THEN concat(measure_prefix, ' ', measure_number) END AS display FROM bill""")
def b2_bill_id(t: Tables) -> DataFrame:
    gap = F.when(C("bill_id") % 5 == 4, "/").when(C("bill_id") % 2 == 0, " - ").otherwise("")
    raw = F.concat(F.lit(" "), F.lower("measure_prefix"), gap, F.when(F.length("measure_number") < 6, F.concat(F.lit("0"), C("measure_number"))).otherwise(C("measure_number")))
    return t.bill.select("bill_id", R.bill_parts(raw).alias("p")).select("bill_id", "p.prefix", "p.number", "p.compact", "p.display")


@query("""SELECT bill_id, CASE WHEN measure_prefix LIKE 'H%' THEN 'House' ELSE 'Senate' END AS chamber, CASE substr(measure_prefix, 2) WHEN 'B' THEN 'Bill' WHEN 'JR' THEN 'Joint Resolution' WHEN 'CR' THEN 'Concurrent Resolution' WHEN 'R' THEN 'Resolution' WHEN 'JM' THEN 'Joint Memorial' ELSE 'Memorial' END AS meaning FROM bill""")
def b3_measure_type(t: Tables) -> DataFrame:
    return t.bill.select("bill_id", R.prefix_chamber(C("measure_prefix")).alias("chamber"), R.prefix_meaning(C("measure_prefix")).alias("meaning"))


@query("SELECT bill_id, CASE WHEN bill_id % 7 = 0 THEN NULL ELSE bill_chamber END AS chamber FROM bill")
def b4_chamber(t: Tables) -> DataFrame:
    code = F.when(C("bill_id") % 7 == 0, "joint").when(C("bill_id") % 3 == 0, F.concat(F.lit(" "), F.lower(F.substring("bill_chamber", 1, 1)))).otherwise(F.upper("bill_chamber"))
    return t.bill.select("bill_id", R.chamber_name(code).alias("chamber"))


@query("SELECT bill_id, session_key, concat(measure_prefix, measure_number) AS compact, concat(measure_prefix, ' ', measure_number) AS display, bill_title AS title, bill_chamber AS chamber, chapter_number IS NOT NULL AS enacted, concat('https://example.org/', session_key, '/Measures/', measure_prefix, measure_number) AS url FROM bill")
def b5_measure(t: Tables) -> DataFrame:
    compact = F.concat("measure_prefix", "measure_number")
    return t.bill.select("bill_id", "session_key", compact.alias("compact"), F.concat_ws(" ", "measure_prefix", "measure_number").alias("display"), X.strip(C("bill_title")).alias("title"), R.prefix_chamber(C("measure_prefix")).alias("chamber"), C("chapter_number").isNotNull().alias("enacted"), F.concat_ws("/", F.lit("https://example.org"), "session_key", F.lit("Measures"), compact).alias("url"))


@query("SELECT s_suppkey, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'chief' WHEN 1 THEN 'regular' ELSE 'unknown' END AS level, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'legislator' WHEN 1 THEN 'committee' ELSE 'other' END AS kind, s_suppkey % 3 <> 2 AS known FROM supplier")
def b6_sponsor(t: Tables) -> DataFrame:
    k = C("s_suppkey")
    level = R.sponsor_level(F.when(k % 3 == 0, " Chief Sponsor").when(k % 3 == 1, "REGULAR").otherwise("filed"))
    return t.supplier.select("s_suppkey", level.alias("level"), R.sponsor_kind(F.when(k % 4 == 0, C("s_name")), F.when(k % 4 == 1, C("s_name")).otherwise(F.lit(" "))).alias("kind"), (level != "unknown").alias("known"))


@query("SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Neutral' WHEN 1 THEN 'Oppose' WHEN 2 THEN 'Support' WHEN 3 THEN CASE WHEN event_id = 3983 THEN 'Support' ELSE concat('Unknown (', event_id, ')') END ELSE event_type END AS position FROM events")
def b7_position(t: Tables) -> DataFrame:
    k = C("event_id")
    raw = F.when(k % 5 < 3, F.concat(F.lit(" "), (k % 5 + 3981).cast("string"))).when(k % 5 == 3, k.cast("string")).otherwise(F.concat(C("event_type"), F.lit(" ")))
    return t.events.select("event_id", R.position(raw).alias("position"))


@query("SELECT doc_key, CASE WHEN document_kind = 'public_testimony' THEN 'legacy_testimony' ELSE document_kind END AS kind, document_kind <> 'unknown' AS known, CASE document_kind WHEN 'public_testimony' THEN 'Written  Testimony' WHEN 'committee_presentation' THEN 'Presentation' WHEN 'floor_letter' THEN 'Floor LETTER' WHEN 'committee_document_other' THEN ' agenda ' ELSE 'Map' END AS raw FROM doc")
def b8_document_type(t: Tables) -> DataFrame:
    k = C("document_kind")
    raw = F.when(k == "public_testimony", "Written  Testimony").when(k == "committee_presentation", "Presentation").when(k == "floor_letter", "Floor LETTER").when(k == "committee_document_other", " agenda ").otherwise("Map")
    return t.doc.select("doc_key", R.document_kind(raw).alias("d")).select("doc_key", "d.kind", "d.known", "d.raw")


@query("SELECT c_custkey, concat(c_mktsegment, ' ', c_name) AS display_name, concat(c_name, '|', c_nationkey) AS meeting_id, CASE WHEN c_custkey % 2 = 0 THEN concat('Joint ', c_mktsegment) ELSE concat('JOINT of ', c_mktsegment) END AS committee FROM customer")
def b9_names(t: Tables) -> DataFrame:
    committee = F.when(C("c_custkey") % 2 == 0, C("c_mktsegment")).otherwise(F.concat(F.lit("JOINT of "), C("c_mktsegment")))
    return t.customer.select("c_custkey", R.display_name(F.concat(F.lit(" "), C("c_mktsegment")), C("c_name")).alias("display_name"), R.meeting_id(C("c_name"), C("c_nationkey").cast("string")).alias("meeting_id"), R.committee_display(committee, F.lit(" Joint")).alias("committee"))


@query("SELECT p_partkey, trim(p_name) AS stripped, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS number FROM part")
def b12_cleaning(t: Tables) -> DataFrame:
    k = C("p_partkey")
    flag = F.element_at(F.array(F.lit(" Yes"), F.lit("0"), F.lit("maybe"), F.lit("")), (k % 4 + 1).cast("int"))
    return t.part.select("p_partkey", X.collapse(F.concat(F.lit("\t "), C("p_name"), F.lit(" \n"))).alias("stripped"), X.parse_bool(flag).alias("flag"), X.parse_int(F.when(k % 3 == 0, F.concat(k, F.lit("abc"))).otherwise(F.concat(F.lit(" +"), k))).alias("number"))


@query("""SELECT s.id, CASE WHEN p.id IS NOT NULL THEN concat('page ', s.id) ELSE concat('source ', s.id) END AS title, CASE WHEN s.id % 3 = 0 THEN NULL ELSE s.id END AS meeting, CASE WHEN s.id % 2 = 0 THEN 'https://example.org' ELSE 'https://example.org/x' END AS url FROM source_side s LEFT JOIN page_side p ON s.id = p.id""")
def b13_testimony(t: Tables) -> DataFrame:
    source = t.source_side.select("id", F.concat(F.lit("source "), C("id")).alias("s_title"), F.when(C("id") % 3 != 0, C("id")).alias("s_date"), F.when(C("id") % 2 == 0, " https://example.org").otherwise("https://example.org/x ").alias("s_url"))
    page = t.page_side.select("id", F.concat(F.lit("page "), C("id")).alias("p_title"))
    return source.join(page, "id", "left").select("id", F.coalesce("p_title", "s_title").alias("title"), C("s_date").alias("meeting"), X.strip(C("s_url")).alias("url"))


@query("SELECT doc_key, CASE WHEN document_kind IN ('committee_presentation', 'legacy_testimony', 'unknown') THEN 'discovered' ELSE 'not_applicable' END AS status FROM doc WHERE document_kind LIKE 'committee%' OR document_kind = 'unknown'")
def b15_committee_documents(t: Tables) -> DataFrame:
    docs = t.doc.where("document_kind like 'committee%' or document_kind = 'unknown'")
    return docs.select("doc_key", F.when(C("document_kind").isin("committee_presentation", "legacy_testimony", "unknown"), "discovered").otherwise("not_applicable").alias("status"))


@query("SELECT doc_key, coalesce(nullif(CASE WHEN source_id % 2 = 0 THEN '' ELSE document_kind END, ''), concat('Letter ', source_id)) AS title, CASE WHEN trim(coalesce(canonical_download_url, '')) <> '' THEN 'discovered' ELSE 'not_applicable' END AS status FROM doc WHERE document_kind = 'floor_letter'")
def b16_floor_letters(t: Tables) -> DataFrame:
    title = F.coalesce(X.collapse(F.when(C("source_id") % 2 != 0, C("document_kind")).otherwise(" ")), F.concat(F.lit("Letter "), C("source_id")))
    return t.doc.where("document_kind = 'floor_letter'").select("doc_key", title.alias("title"), F.when(X.blank(C("canonical_download_url")), "not_applicable").otherwise("discovered").alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS stamp, CASE WHEN event_id % 4 <> 0 THEN ts END AS at FROM events")
def b17_timestamps(t: Tables) -> DataFrame:
    raw = F.when(C("event_id") % 4 == 0, "never").otherwise(F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return t.events.select("event_id", R.utc_stamp(raw).alias("stamp"), R.source_date(raw).alias("at"))


@query(r"""SELECT page_id, CASE WHEN url NOT LIKE 'https://%' THEN 'not_https' WHEN page_id % 10 = 1 THEN 'user_info' WHEN page_id % 10 = 2 THEN 'bad_port' WHEN NOT url LIKE '%.example.com/%' OR length(regexp_extract(url, '^https://([^/]*)', 1)) > 18 THEN 'unexpected_host' END AS finding FROM pages""")
def b19_url_audit(t: Tables) -> DataFrame:
    k = C("page_id") % 10
    url = F.when(k == 1, F.replace(C("url"), F.lit("://"), F.lit("://me@"))).when(k == 2, F.regexp_replace("url", "^([^/]*//[^/]*)", "$1:8443")).when(k == 3, F.regexp_replace("url", "^([^/]*//[^/]*)", "$1.:443")).otherwise(C("url"))
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    good = t.pages.select(host.alias("good")).where("good like '%.example.com' and length(good) <= 18").distinct()  # the allow-list, as a table
    checked = t.pages.select("page_id", url.alias("url"), host.alias("host")).join(good, C("host") == C("good"), "left")
    return checked.select("page_id", F.coalesce(F.when(R.url_findings(C("url"), ["-"]) != "unexpected_host", R.url_findings(C("url"), ["-"])), F.when(C("good").isNull(), "unexpected_host")).alias("finding"))


@query("SELECT doc_key, concat(session_key, '/', measure_prefix, measure_number, '/', document_kind, '/', source_id, '/', replace(doc_key, '-', '_'), CASE WHEN d.bill_id % 3 > 0 THEN concat('__v000', CAST(d.bill_id % 3 + 1 AS INT)) ELSE '' END, '.pdf') AS path FROM doc d JOIN bill b ON d.bill_id = b.bill_id")
def b20_archive_paths(t: Tables) -> DataFrame:
    both = t.doc.join(t.bill.select("bill_id", "session_key", "measure_prefix", "measure_number"), "bill_id")
    name = F.concat(F.lit(" "), F.replace(C("doc_key"), F.lit("-"), F.lit("?")), F.lit(".pdf."))
    return both.select("doc_key", R.archive_path(C("session_key"), F.concat("measure_prefix", "measure_number"), C("document_kind"), C("source_id").cast("string"), name, C("bill_id") % 3 + 1).alias("path"))


@query("SELECT l_partkey % 100 AS k, count(*) AS n FROM lineitem WHERE l_partkey % 100 > 0 AND l_linenumber > 1 GROUP BY 1")
def b21_positive_ids(t: Tables) -> DataFrame:
    raw = F.when(C("l_linenumber") == 1, F.concat(F.lit("0"), C("l_partkey") % 100)).otherwise((C("l_partkey") % 100).cast("string"))
    return t.lineitem.select(R.positive_id(raw).alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT doc_key, CASE CAST(bill_id % 4 AS INT) WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/html' ELSE 'x/y' END AS mime, CASE CAST(bill_id % 4 AS INT) WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' WHEN 2 THEN '.html' END AS extension, CASE CAST(bill_id % 4 AS INT) WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false END AS fits FROM doc")
def b22_mime(t: Tables) -> DataFrame:
    k = C("bill_id") % 4
    raw = F.when(k == 0, "Application/PDF; charset=x").when(k == 1, " image/jpeg").when(k == 2, "text/html").otherwise("x/y")
    return t.doc.select("doc_key", R.mime_type(raw).alias("mime"), R.mime_extension(raw).alias("extension"), R.extension_fits(F.lit("a.JPEG"), raw).alias("fits"))


@query("SELECT c_custkey AS id, c_name AS title, c_nationkey AS nation FROM customer")
def b23_aliases(t: Tables) -> DataFrame:
    return P.project_allowed(t.customer.withColumnRenamed("c_nationkey", "nation"), {"c_custkey": "id", "c_name": "title"}, ["id", "title", "nation", "absent"])


@query("SELECT event_id, greatest(least(300.0, 2.0 * pow(2.0, event_id % 10)), CASE WHEN event_id % 3 = 0 THEN least(3600.0, event_id) ELSE 0.0 END) AS wait FROM events")
def b24_backoff(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.backoff(C("event_id") % 10 + 1, F.when(C("event_id") % 3 == 0, C("event_id"))).alias("wait"))


@query("SELECT doc_key, CASE WHEN bill_id % 3 = 0 THEN downloaded_bytes WHEN bill_id % 3 = 2 THEN downloaded_bytes + 1 END AS size FROM doc")
def b25_sizes(t: Tables) -> DataFrame:
    k, n = C("bill_id") % 3, C("downloaded_bytes")
    ranges = F.when(k == 0, F.concat(F.lit("bytes 0-0/"), n)).when(k == 1, "bytes 0-0/*")
    return t.doc.select("doc_key", R.total_size(F.when(k == 2, 200).otherwise(206), ranges, (n + 1).cast("string")).alias("size"))


@query("SELECT CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'chief' WHEN 1 THEN 'regular' WHEN 2 THEN 'filing_notice' ELSE 'unmapped' END AS bucket, count(*) AS n FROM supplier GROUP BY 1")
def b26_buckets(t: Tables) -> DataFrame:
    k = C("s_suppkey") % 4
    return t.supplier.select(R.sponsor_bucket(F.when(k == 0, "Chief").when(k == 1, "regular"), F.when(k == 2, "filed")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT doc_key, CASE WHEN displayed IS NULL THEN 'unknown' WHEN displayed THEN 'yes' ELSE 'no' END AS displayed FROM doc")
def b27_yes_no(t: Tables) -> DataFrame:
    return t.doc.select("doc_key", X.yes_no_unknown(C("displayed")).alias("displayed"))


@query("SELECT bill_id FROM bill WHERE session_key = '1996R1' AND bill_chamber = 'House' AND (lower(bill_title) LIKE '%ur_ent%' OR measure_number LIKE '%ur_ent%') AND trim(coalesce(chapter_number, '')) <> ''")
def c1_bill_search(t: Tables) -> DataFrame:
    return filters.bill_search(t.bill, " 1996r1", "House", "uR_ent", True).select("bill_id")


@query("SELECT trim(coalesce(chapter_number, '')) <> '' AS enacted, count(*) AS n FROM bill GROUP BY 1")
def c2_enacted(t: Tables) -> DataFrame:
    return t.bill.select(filters.enacted(F.lit(None).cast("boolean"), C("chapter_number"), True).alias("enacted")).groupBy("enacted").agg(F.count("*").alias("n"))


@query("SELECT doc_key FROM doc WHERE document_kind = 'floor_letter' AND canonical_download_url LIKE '%host3%' AND displayed IS NULL AND download_status IN ('failed_retryable', 'failed_terminal')")
def c3_document_search(t: Tables) -> DataFrame:
    return filters.document_search(t.doc, kind="floor_letter", url="HOST3", displayed="unknown", failed_only=True).select("doc_key")


@query("SELECT run_id, item_key FROM item WHERE status = 'skipped' AND (CAST(item_key AS VARCHAR) LIKE '%12%' OR run_id = 12)")
def c4_run_search(t: Tables) -> DataFrame:
    items = filters.run_search(t.item, "skipped", "12").union(filters.run_search(t.item, "skipped", "#12")).distinct()
    return items.select("run_id", "item_key")


@query("SELECT id, run_id FROM err WHERE resolved_at IS NULL AND lower(message) LIKE '%1%'")
def c5_errors(t: Tables) -> DataFrame:
    return filters.ledger_search(filters.open_rows(t.err), "1").select("id", "run_id")


@query("SELECT id FROM anom WHERE run_id = 7 AND affects_completeness")
def c6_anomalies(t: Tables) -> DataFrame:
    return filters.ledger_search(t.anom, run=7).where("affects_completeness").select("id")


@query("SELECT doc_key, session_key FROM doc d JOIN bill b ON d.bill_id = b.bill_id WHERE CAST(substr(session_key, 1, 4) AS INT) >= 1995 AND download_status IN ('failed_retryable', 'interrupted', 'missing_local', 'paused_low_space') AND document_kind IN ('public_testimony', 'legacy_testimony', 'committee_presentation', 'floor_letter') AND trim(coalesce(canonical_download_url, '')) <> ''")
def c7_retry_eligible(t: Tables) -> DataFrame:
    return filters.retry_eligible(t.doc, t.bill, 1995, include_terminal=False).select("doc_key", "session_key")


@query("SELECT count(*) AS n, CAST(sum(downloaded_bytes) AS BIGINT) AS bytes FROM doc WHERE document_kind IN ('public_testimony', 'committee_presentation', 'floor_letter') AND download_status <> 'not_applicable' AND trim(coalesce(canonical_download_url, '')) <> ''")
def c8_candidates(t: Tables) -> DataFrame:
    return filters.download_candidates(t.doc).agg(F.count("*").alias("n"), F.sum("downloaded_bytes").alias("bytes"))


@query("SELECT bill_id, session_key, measure_prefix FROM bill WHERE session_key = '1995R1' AND concat(measure_prefix, measure_number) IN (SELECT concat(measure_prefix, measure_number) FROM bill WHERE source_presence = 'missing')")
def c10_keyed_lookup(t: Tables) -> DataFrame:
    wanted = t.bill.where("source_presence = 'missing'").select(F.concat("measure_prefix", "measure_number").alias("compact")).distinct()
    return t.bill.where("session_key = '1995R1'").withColumn("compact", F.concat("measure_prefix", "measure_number")).join(wanted, "compact", "left_semi").select("bill_id", "session_key", "measure_prefix")


@query("SELECT count(*) AS n FROM anom WHERE resolved_at IS NULL AND run_id = (SELECT max(run_id) FROM item)")
def c11_latest_run_anomalies(t: Tables) -> DataFrame:
    latest = t.item.agg(F.max("run_id").alias("latest"))
    return filters.open_rows(t.anom).join(F.broadcast(latest), C("run_id") == C("latest")).agg(F.count("*").alias("n"))


@query("SELECT page_id, 'parser_anomalous' AS outcome, CAST(0 AS BIGINT) AS n_rows FROM pages")
def a8_page_outcomes(t: Tables) -> DataFrame:
    return html_tables.classify_pages(html_tables.parse_pages(t.pages))


@query("SELECT doc_id, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'jpg' WHEN 3 THEN 'txt' END AS type, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'strong' WHEN 1 THEN 'strong' WHEN 2 THEN 'declared' WHEN 3 THEN 'filename' ELSE 'none' END AS confidence FROM documents")
def a10_signatures(t: Tables) -> DataFrame:
    k = C("doc_id") % 5
    body = F.concat(F.when(k == 0, "%PDF-").when(k == 1, " <!DOCTYPE html>").otherwise("~"), C("text")).cast("binary")
    files = t.documents.select("doc_id", F.when(k == 3, "a/b.TXT").otherwise("a/b").alias("path"), body.alias("content"), F.when(k == 2, "image/JPEG; q=1").alias("declared_mime"))
    return payloads.detect_types(files).select("doc_id", "type", "confidence")


@query("SELECT doc_id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'length_mismatch' WHEN 1 THEN 'html' WHEN 2 THEN 'no_signature' WHEN 3 THEN 'pdf_without_end' WHEN 4 THEN 'hash_mismatch' ELSE 'valid' END AS verdict FROM documents")
def a11_payload_validation(t: Tables) -> DataFrame:
    k = C("doc_id") % 6
    body = F.concat(F.when(k == 1, "<html>").when(k == 2, "~").otherwise("%PDF-"), C("text"), F.when(k > 3, "%%EOF").otherwise("")).cast("binary")
    path = C("doc_id").cast("string").alias("path")
    files = t.documents.select(path, body.alias("content"))
    expected = t.documents.select(path, F.when(k == 0, 1).alias("expected_length"), F.lit("pdf").alias("expected_type"), F.when(k == 4, "00").alias("expected_sha256"))
    return payloads.validate_payloads(files, expected).select(C("path").cast("bigint").alias("doc_id"), "verdict")
