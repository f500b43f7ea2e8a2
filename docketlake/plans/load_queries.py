"""Queries of loads: whole sessions with all their entities, deltas merged on read, streaks with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.operators import session_load, tracked
from docketlake.plans.registry import query
from docketlake.plans.standins import Tables
from docketlake.streaming import deltas, loads, streaks

C = F.col
_NOW = "TIMESTAMP '2024-06-01 00:00:00'"


@query("""SELECT user_id, event_id AS at, CAST(place AS INT) AS n FROM (SELECT user_id, event_id, f, row_number() OVER (PARTITION BY user_id, island, f ORDER BY event_id) AS place
FROM (SELECT user_id, event_id, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, event_type IN ('error', 'signup', 'view') AS f FROM events))) WHERE f AND place >= 3""")
def s4_keyed_streaks(t: Tables) -> DataFrame:
    """Events arrive in three deliveries; each starts the query again, which goes on from its state. The third brings the second once more."""
    landing, root = (loads.shared_folder(t.spark, name) for name in ("outcomes", "streaks"))
    events = t.events.select("user_id", "event_id", C("event_type").isin("error", "signup", "view").alias("failed"), C("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(C("event_id") * 3 / (last + 1))
    for delivery in ([0], [1], [1, 2]):
        events.where(part.isin(delivery)).write.mode("append").parquet(landing)
        stream = t.spark.readStream.schema(events.schema).parquet(landing)
        found = streaks.run_streaks(streaks.keyed_streaks(stream, "user_id", "event_id", "failed", "ts", lateness="3650 days"), root)
    return found


@query("SELECT event_id, user_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'late' WHEN event_id % 7 = 0 THEN 'later' ELSE props END AS said FROM events")
def s2_delta_load(t: Tables) -> DataFrame:
    """Events, then a third of them again, then a seventh: three batches of deltas by type, compacted once, merged on read."""
    root = loads.shared_folder(t.spark, "deltas")
    rows = t.events.select("event_id", "user_id", C("event_type").alias("kind"), C("props").alias("said"))
    schema = "event_id bigint, user_id bigint, kind string, said string"
    again = [rows, rows.where("event_id % 7 = 0").withColumn("said", F.lit("later")), rows.where("event_id % 3 = 0").withColumn("said", F.lit("late"))]
    for number, delivery in enumerate(again):
        delivery.write.mode("append").json(f"{root}/landing")
        deltas.load_deltas(t.spark, f"{root}/landing", schema, ["event_id"], "kind", f"{root}/table", f"{root}/offsets").awaitTermination()
        if number == 1:
            deltas.compact(t.spark, f"{root}/table", ["event_id"], "kind", deltas=2)
    return deltas.snapshot(t.spark, f"{root}/table", ["event_id"], "kind")


_KEY = "concat_ws('-', CAST(l_orderkey AS string), CAST(l_linenumber AS string), CAST(l_partkey AS string), CAST(l_suppkey AS string))"
_YEAR = "CAST(year(o_orderdate) AS string)"
_BILL = f"concat({_YEAR}, 'R1') AS session_key, concat(CASE CAST(o_orderkey % 3 AS int) WHEN 0 THEN 'HB' WHEN 1 THEN 'SB' ELSE 'HJR' END, CAST(o_orderkey AS string)) AS bill, CASE CAST(o_orderkey % 3 AS int) WHEN 0 THEN 'HB' WHEN 1 THEN 'SB' ELSE 'HJR' END AS measure_prefix, CAST(o_orderdate AS timestamp) AS modified_at"
_OTHER = "concat(CAST(1995 + {k} % 7 AS string), 'R1') AS session_key, CAST(concat(CAST(1995 + {k} % 7 AS string), '-', lpad(CAST(1 + {k} % 12 AS string), 2, '0'), '-01') AS timestamp) AS modified_at"
_DOCS = f"""SELECT {_BILL}, source_id, h, CASE WHEN h % 8 = 1 THEN 'unknown' ELSE 'committee_presentation' END AS document_kind, CASE WHEN h % 6 = 0 THEN NULL ELSE concat('type ', CAST(h % 4 AS string)) END AS raw_document_type, concat('https://host/', CAST(h AS string)) AS url,
CASE CAST(h % 3 AS int) WHEN 0 THEN 'downloaded' WHEN 1 THEN 'queued' ELSE 'failed_terminal' END AS download_status, CASE WHEN h % 11 = 0 THEN 'missing' ELSE 'active' END AS source_presence, CASE WHEN h % 9 = 0 THEN 'page_only' ELSE 'both' END AS origin
FROM (SELECT l_orderkey, {_KEY} AS source_id, max(l_partkey) AS h, max(l_returnflag) AS f FROM {{lineitem}} GROUP BY 1, 2) l JOIN {{orders}} o ON o_orderkey = l_orderkey WHERE f = '{{flag}}' AND o_orderkey % 10 <> 3"""
#: Rows of each entity as a source would have them; h decides what is known before, what is landed, and what has changed.
SOURCES = {
    "Legislators": f"SELECT {_OTHER.format(k='c_custkey')}, concat('L', CAST(c_custkey AS string)) AS legislator_code, c_custkey AS h, c_name AS title FROM {{customer}}",
    "Committees": f"SELECT {_OTHER.format(k='s_suppkey')}, concat('C', CAST(s_suppkey AS string)) AS committee_code, s_suppkey AS h, s_name AS title FROM {{supplier}}",
    "Measures": f"SELECT {_BILL}, o_orderkey AS h, o_orderpriority AS title, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' ELSE 'active' END AS source_presence FROM {{orders}}",
    "MeasureSponsors": f"SELECT {_BILL}, concat('S', CAST(o_orderkey AS string)) AS sponsor_id, o_orderkey AS h, o_clerk AS title FROM (SELECT o_orderdate, o_orderkey, CAST(o_custkey AS string) AS o_clerk FROM {{orders}}) o",
    "CommitteeMeetings": f"SELECT {_OTHER.format(k='s_suppkey')}, concat('C', CAST(s_suppkey AS string)) AS committee_code, concat('C', CAST(s_suppkey AS string), '|m') AS meeting_id, s_suppkey AS h, s_name AS title FROM {{supplier}}",
    "CommitteeAgendaItems": f"SELECT {_BILL}, concat('A', CAST(o_orderkey AS string)) AS agenda_id, CASE WHEN o_orderkey % 5 > 0 THEN concat('C', CAST(CASE WHEN year(o_orderdate) = 1995 THEN 7 ELSE year(o_orderdate) - 1995 END AS string), '|m') END AS meeting_id, o_orderkey AS h, o_orderpriority AS title FROM {{orders}}",
    "CommitteeMeetingDocuments": _DOCS.replace("{flag}", "R"),
    "CommitteePublicTestimonies": _DOCS.replace("{flag}", "A"),
    "FloorLetters": _DOCS.replace("{flag}", "N"),
}
_DOCUMENTS = tuple(SOURCES)[-3:]
#: What has changed in the landed rows of documents, by column.
_CHANGED = {"document_kind": "CASE WHEN h % 16 = 2 THEN 'floor_letter' ELSE document_kind END", "raw_document_type": "CASE WHEN h % 5 = 0 THEN 'type x' ELSE raw_document_type END", "url": "CASE WHEN h % 4 = 0 THEN concat(url, '?v=2') ELSE url END"}


#: The family of each kind of documents; all are made once, and landed by family.
_FLAGS = {name: flag for name, flag in zip(_DOCUMENTS, "RAN", strict=True)}
_LANDED = _DOCS.replace("h % 9 = 0 THEN 'page_only' ELSE 'both' END AS origin", "h % 9 = 0 THEN 'page_only' ELSE 'both' END AS origin, f").replace("WHERE f = '{flag}' AND", "WHERE f IN ('R', 'A', 'N') AND")


def _sides(t: Tables, name: str, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, landed) of an entity. documents: the rows of _LANDED. The session of 1997 is answered with a committee of another, that of 2000 with a sponsor of no measure."""
    rows = documents.where(C("f") == _FLAGS[name]).drop("f") if name in _FLAGS else t.spark.sql(SOURCES[name].format(**t.names))
    landed = rows.where("h % 10 <> 7").withColumn("asked", C("session_key"))
    if "measure_prefix" in rows.columns:
        landed = landed.where("measure_prefix <> 'HJR'")
    if name in _DOCUMENTS:
        landed = landed.withColumns({c: F.expr(e) for c, e in _CHANGED.items()}).drop("download_status", "source_presence", "origin").withColumn("source_modified_at", C("modified_at").cast("string"))
        rows = rows.withColumn("source_modified_at", C("modified_at").cast("string"))
    else:
        landed = landed.withColumn("title", F.when(C("h") % 6 == 0, "changed").otherwise(C("title"))).drop("source_presence")
    if name == "Committees":
        landed = landed.union(landed.where("h = 3").withColumn("asked", F.lit("1997R1")))
    if name == "MeasureSponsors":
        landed = landed.unionByName(landed.where("session_key = '2000R1'").limit(1).withColumn("bill", F.lit("HB0")).withColumn("sponsor_id", F.lit("S0")))
    seen = F.to_timestamp(F.lit("2000-01-01"))
    target = rows.where("h % 10 <> 3").drop("h").withColumns({"first_seen_at": seen, "last_seen_at": seen})
    if "source_presence" in rows.columns:
        target = target.withColumn("missing_since", F.when(C("source_presence") == "missing", seen))
    return target, landed.drop("h")


_STOPS = {"1997R1": "Committees", "1998R1": "CommitteeMeetings", "2000R1": "MeasureSponsors"}
_ERRORS = {"1997R1": "1 rows outside the scope", "1998R1": "timeout", "2000R1": "1 rows without their Measures"}
_NAMES = list(SOURCES)


def _entity_sql(entity: session_load.Entity) -> str:
    """DuckDB: (frame, entity, session_key, id, value) of one entity's rows, events and findings."""
    name, key, docs = entity.name, entity.key, entity.name in _DOCUMENTS
    src = SOURCES[name].format(lineitem="lineitem", orders="orders", customer="customer", supplier="supplier")
    later = [s for s, at in _STOPS.items() if _NAMES.index(at) <= _NAMES.index(name)]
    stopped = f"session_key IN ({', '.join(repr(s) for s in later)})" if later else "false"
    whole = "true" if not entity.dated else "CAST(substr(session_key, 1, 4) AS INT) % 2 = 1"
    since = f"({whole} OR modified_at >= CAST(concat(substr(session_key, 1, 4), '-07-01') AS TIMESTAMP))"
    scoped = "AND measure_prefix <> 'HJR'" if entity.scoped else ""
    cte = f"x AS ({src}), o AS (SELECT * FROM x WHERE h % 10 <> 3), n AS (SELECT * FROM x WHERE h % 10 <> 7 AND NOT {stopped} AND {since} {scoped})"
    ident = f"coalesce(o.{key}, n.{key})"
    join = f"o FULL JOIN n ON o.session_key = n.session_key AND o.{key} = n.{key}"
    session = "coalesce(o.session_key, n.session_key)"
    if not entity.tracked:
        return f"SELECT * FROM (WITH {cte} SELECT 'rows' AS frame, '{name}' AS entity, {session} AS session_key, {ident} AS id, CASE WHEN n.h IS NULL THEN o.title WHEN n.h % 6 = 0 THEN 'changed' ELSE n.title END AS value FROM {join})"
    gone = f"(n.h IS NULL AND NOT o.{stopped} AND o.{whole} {scoped.replace('measure_prefix', 'o.measure_prefix')} {'AND o.origin <> ' + chr(39) + 'page_only' + chr(39) if docs else ''})"
    gone = gone.replace("o.CAST(substr(session_key", "CAST(substr(o.session_key").replace("o.true", "true").replace("o.false", "false")
    presence = f"CASE WHEN n.h IS NOT NULL THEN 'active' WHEN {gone} THEN 'missing' ELSE o.source_presence END"
    if docs:
        new = {c: e.replace("h %", "n.h %").replace(f"ELSE {c} ", f"ELSE n.{c} ").replace("concat(url", "concat(n.url") for c, e in _CHANGED.items()}
        kind = f"coalesce(CASE WHEN n.h IS NOT NULL THEN {new['document_kind']} END, o.document_kind)"
        status = "CASE WHEN o.h IS NULL THEN 'discovered' WHEN n.h IS NOT NULL AND o.download_status = 'downloaded' AND n.h % 4 = 0 THEN 'changed_remote' ELSE o.download_status END"
        value = f"concat_ws('|', {kind}, {status}, presence, CASE WHEN n.h IS NULL THEN o.raw_document_type ELSE {new['raw_document_type']} END)"
    else:
        value = "concat_ws('|', CASE WHEN n.h IS NULL THEN o.title WHEN n.h % 6 = 0 THEN 'changed' ELSE n.title END, presence)"
    base = f"(SELECT {session} AS s, {ident} AS id, o.h IS NOT NULL AS is_old, n.h IS NOT NULL AS is_new, o.source_presence AS was, {presence} AS presence, {value.replace('presence,', presence + ',').replace(', presence)', ', ' + presence + ')')} AS value"
    if docs:
        base += f", o.document_kind AS k1, {kind} AS k2, o.raw_document_type AS r1, CASE WHEN n.h IS NOT NULL THEN {new['raw_document_type']} END AS r2"
    base += f" FROM {join})"
    out = f"SELECT * FROM (WITH {cte}, b AS {base} SELECT 'rows' AS frame, '{name}' AS entity, s AS session_key, id, value FROM b UNION ALL SELECT 'events', '{name}', s, id, concat(was, '>', presence) FROM b WHERE is_old AND was <> presence"
    if docs:
        out += f" UNION ALL SELECT 'anomalies', '', s, '', concat_ws('|', 1, 'raw_document_type_changed {name}', id) FROM b WHERE is_old AND is_new AND r1 <> r2 UNION ALL SELECT 'anomalies', '', s, '', concat_ws('|', 1, 'normalized_document_kind_changed {name}', id) FROM b WHERE is_old AND is_new AND k1 <> k2 UNION ALL SELECT 'anomalies', '', s, '', concat_ws('|', 1, 'unknown_document_type {name}', id) FROM b WHERE is_new AND k2 = 'unknown'"
    return out + ")"


def _sync_sql() -> str:
    parts = []
    for k, entity in enumerate(session_load.ENTITIES):
        src = SOURCES[entity.name].format(lineitem="lineitem", orders="orders", customer="customer", supplier="supplier")
        at = {s: _NAMES.index(e) for s, e in _STOPS.items()}
        stop = "CASE y.session_key " + " ".join(f"WHEN '{s}' THEN {i}" for s, i in at.items()) + " ELSE 99 END"
        error = "CASE y.session_key " + " ".join(f"WHEN '{s}' THEN '{e}'" for s, e in _ERRORS.items()) + " END"
        cursor = "CASE WHEN y.y % 2 = 0 THEN concat(y.y, '-07-01 00:00:00') END" if entity.dated else "CAST(NULL AS VARCHAR)"
        scoped = "AND measure_prefix <> 'HJR'" if entity.scoped else ""
        latest = f"(SELECT CAST(max(modified_at) AS VARCHAR) FROM ({src}) x WHERE x.session_key = y.session_key AND h % 10 <> 7 {scoped} AND (y.y % 2 = 1 OR modified_at >= CAST(concat(y.y, '-07-01') AS TIMESTAMP)))" if entity.dated else "NULL"
        parts.append(f"SELECT 'sync' AS frame, '{entity.name}' AS entity, y.session_key, '' AS id, concat_ws('|', CASE WHEN {k} < {stop} THEN coalesce({latest}, {cursor}) ELSE {cursor} END, CASE WHEN {k} < {stop} THEN 'true' ELSE 'false' END, CASE WHEN {k} < {stop} THEN NULL WHEN {k} = {stop} THEN {error} ELSE 'old' END) AS value FROM (SELECT session_key, CAST(substr(session_key, 1, 4) AS INT) AS y FROM sess) y")
    return " UNION ALL ".join(parts)


_REST = f"""SELECT 'sessions' AS frame, coalesce(CASE session_key {' '.join(f"WHEN '{s}' THEN '{e}'" for s, e in _STOPS.items())} END, '') AS entity, session_key, '' AS id, CASE WHEN session_key IN ('1997R1', '1998R1', '2000R1', '2001R1') THEN 'inventory_incomplete' WHEN session_key = '1996R1' THEN 'inventory_complete_with_errors' ELSE 'inventory_complete' END AS value FROM sess
UNION ALL SELECT 'errors', CASE session_key {' '.join(f"WHEN '{s}' THEN '{e}'" for s, e in _STOPS.items())} END, session_key, '', CASE session_key {' '.join(f"WHEN '{s}' THEN '{e}'" for s, e in _ERRORS.items())} END FROM sess WHERE session_key IN ('1997R1', '1998R1', '2000R1')
UNION ALL SELECT 'anomalies', '', session_key, '', '4|gap' FROM sess WHERE session_key IN ('1995R1', '2001R1')"""


@query(" UNION ALL ".join([*map(_entity_sql, session_load.ENTITIES), _sync_sql(), _REST]))
def r11_session_load(t: Tables) -> DataFrame:
    """Seven sessions loaded with nine entity sets, three of which fail at different ones; every published table as (frame, entity, session_key, id, value)."""
    spark, root = t.spark, loads.shared_folder(t.spark, "sessions")
    folder = loads.shared_folder(spark, "documents")
    made = spark.sql(_LANDED.format(**t.names))
    made.write.partitionBy("f").parquet(folder)
    documents = spark.read.schema(made.schema).parquet(folder)
    sides = {name: _sides(t, name, documents) for name in SOURCES}
    year = F.substring("session_key", 1, 4).cast("int")
    dated = F.array(*[F.lit(e.name) for e in session_load.ENTITIES if e.dated])
    sync = t.sess.select("session_key", F.explode(F.array(*map(F.lit, _NAMES))).alias("entity"))
    sync = sync.select("session_key", "entity", F.when((year % 2 == 0) & F.array_contains(dated, C("entity")), F.to_timestamp(F.concat(year, F.lit("-07-01")))).alias("cursor"), F.lit(False).alias("complete"), F.lit("old").alias("last_error"))
    failures = t.sess.where("session_key = '1998R1'").select("session_key", F.lit("CommitteeMeetings").alias("entity"), F.lit("timeout").alias("error"))
    old = F.to_timestamp(F.lit("2000-01-01"))
    ledger = t.sess.where("session_key in ('1995R1', '2001R1')").select(F.concat(F.lit("gap-"), "session_key").alias("fingerprint"), "session_key", F.lit(True).alias("affects_completeness"), old.alias("first_seen"), old.alias("last_seen"), F.lit(4).cast("long").alias("occurrences"), F.when(C("session_key") == "1995R1", old).alias("resolved_at"), F.lit("gap").alias("message"))
    probes = t.sess.select("session_key", F.when(C("session_key") == "1996R1", 2).otherwise(0).alias("failed"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    session_load.load_sessions(spark, root, {n: s[0] for n, s in sides.items()}, {n: s[1] for n, s in sides.items()}, sync, failures, ledger, probes, ["HB", "SB"], now, 1)
    read = lambda name: session_load.table(spark, root, name)
    shape = lambda rows, frame, entity, ident, value: rows.select(F.lit(frame).alias("frame"), F.coalesce(entity, F.lit("")).alias("entity"), "session_key", ident.alias("id"), value.alias("value"))
    none = F.lit("")
    frames = []
    for entity in session_load.ENTITIES:
        value = F.concat_ws("|", "document_kind", "download_status", "source_presence", "raw_document_type") if entity.name in _DOCUMENTS else F.concat_ws("|", "title", "source_presence") if entity.tracked else C("title")
        frames.append(shape(read(entity.name), "rows", F.lit(entity.name), C(entity.key), value))
    frames += [
        shape(read("events"), "events", C("entity"), C("id"), F.concat("previous", F.lit(">"), "current")),
        shape(read("anomalies"), "anomalies", none, none, F.concat_ws("|", "occurrences", F.regexp_replace("message", r"^(\S+ \S+) ", "$1|"))),
        shape(read("errors"), "errors", C("entity"), none, C("error")),
        shape(read("sync"), "sync", C("entity"), none, F.concat_ws("|", C("cursor").cast("string"), C("complete").cast("string"), "last_error")),
        shape(read("sessions"), "sessions", C("stopped_at"), none, C("inventory_status")),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out
