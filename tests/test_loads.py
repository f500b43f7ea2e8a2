"""Tracked merges, loads of sessions, frozen lists and download states on literal rows."""

import pytest
from pyspark.sql import functions as F

from docketlake.functions import routes, text
from docketlake.operators import archive, display, rollups, session_load, tracked

def _now():
    return F.to_timestamp(F.lit("2024-06-01"))


DOCS = "session_key string, source_id string, document_kind string, raw_document_type string, url string, source_modified_at string, download_status string, source_presence string, missing_since timestamp, first_seen_at timestamp, last_seen_at timestamp, origin string"


def _doc(ident, kind="floor_letter", raw="Letter", url="u", at="1", status="downloaded", presence="active", origin="both", session="s"):
    return (session, ident, kind, raw, url, at, status, presence, None, None, None, origin)


def test_one_merge_gives_rows_and_typed_findings(spark):
    known = spark.createDataFrame([_doc("same"), _doc("url"), _doc("date", status="queued"), _doc("raw"), _doc("kind"), _doc("gone"), _doc("page", origin="page_only"), _doc("back", presence="missing"), _doc("other", session="t"), _doc("norawnow"), _doc("blank", url=None)], DOCS)
    rows = [("same", "floor_letter", "Letter", "u", "1", "x"), ("url", "floor_letter", "Letter", "v", "1", "x"), ("date", "floor_letter", "Letter", "u", "2", "x"), ("raw", "floor_letter", "letter", " u ", "1", "x"), ("kind", "unknown", "Letter", "u", "1", "x"), ("back", None, "Letter", None, None, "x"), ("new", None, "Odd", "u", None, "unclassified"), ("norawnow", "floor_letter", None, "u", "1", "x"), ("blank", "floor_letter", "Letter", "", "1", "x")]
    fresh = spark.createDataFrame([("s", *r) for r in rows], "session_key string, source_id string, document_kind string, raw_document_type string, url string, source_modified_at string, classification_method string")
    whole = spark.createDataFrame([("s",)], "session_key string")
    merged = tracked.merge_tracked(known, fresh, ["session_key", "source_id"], _now(), whole)
    got = {r["source_id"]: (r["document_kind"], r["download_status"], r["source_presence"], r["missing_since"] is not None, sorted(f["finding"] for f in r["findings"])) for r in merged.collect()}
    keep = ("floor_letter", "downloaded", "active", False, [])
    assert got == {
        "same": keep, "other": keep, "page": keep, "norawnow": keep, "blank": keep,
        "url": ("floor_letter", "changed_remote", "active", False, []),
        "date": ("floor_letter", "queued", "active", False, []),
        "raw": ("floor_letter", "downloaded", "active", False, [tracked.RAW_TYPE]),
        "kind": ("unknown", "downloaded", "active", False, [tracked.KIND, tracked.UNKNOWN]),
        "gone": ("floor_letter", "downloaded", "missing", True, [tracked.PRESENCE]),
        "back": ("floor_letter", "downloaded", "active", False, [tracked.PRESENCE]),
        "new": ("unknown", "discovered", "active", False, [tracked.UNKNOWN]),
    }
    events = tracked.findings_of(merged, ["source_id"], tracked.PRESENCE).collect()
    assert sorted(map(tuple, events)) == [("back", "missing", "active"), ("gone", "active", "missing")]
    part = tracked.merge_tracked(known, fresh, ["session_key", "source_id"], _now())
    assert part.where("source_id = 'gone'").first()["source_presence"] == "active"  # a read in part proves no absence
    assert tracked.merge_tracked(known.limit(0), fresh.limit(0), ["session_key", "source_id"], _now(), whole).count() == 0


def test_a_run_is_published_once_and_whole(spark, tmp_path):
    root = str(tmp_path)
    columns = {"Legislators": "legislator_code", "Committees": "committee_code", "MeasureSponsors": "sponsor_id", "CommitteeMeetings": "meeting_id", "CommitteeAgendaItems": "agenda_id"}
    targets, landed = {}, {}
    for e in session_load.ENTITIES:
        schema = f"session_key string, {e.key} string, title string, modified_at timestamp" + (", measure_prefix string" if e.scoped else "") + "".join(f", {own} string" for _, _, own in e.parents if own != e.key)
        targets[e.name] = spark.createDataFrame([], schema + ", source_presence string, missing_since timestamp, first_seen_at timestamp, last_seen_at timestamp")
        values = {"session_key": "s", e.key: "k", "title": "t", "measure_prefix": "HB", "bill": "k", "committee_code": "k", "meeting_id": "k", "asked": "s"}
        frame = spark.createDataFrame([tuple(values.get(f.name) for f in spark.createDataFrame([], schema + ", asked string").schema)], schema + ", asked string")
        landed[e.name] = frame.withColumn("modified_at", _now())
    assert set(columns) < {e.name for e in session_load.ENTITIES}
    sync = spark.createDataFrame([("s", e.name, None, False, "old") for e in session_load.ENTITIES], "session_key string, entity string, cursor timestamp, complete boolean, last_error string")
    failures = spark.createDataFrame([], "session_key string, entity string, error string")
    ledger = spark.createDataFrame([], "fingerprint string, session_key string, affects_completeness boolean, first_seen timestamp, last_seen timestamp, occurrences long, resolved_at timestamp, message string")
    probes = spark.createDataFrame([], "session_key string, failed int")
    load = lambda run, **more: session_load.load_sessions(spark, root, targets, landed, sync, more.get("failures", failures), ledger, probes, ["HB"], _now(), run)
    with pytest.raises(ValueError, match="no run"):
        session_load.table(spark, root, "sync")
    assert load(1) and not load(1)
    assert [tuple(r) for r in session_load.table(spark, root, "sessions").collect()] == [("s", "inventory_complete", None)]
    assert {e.name: session_load.table(spark, root, e.name).count() for e in session_load.ENTITIES} == {e.name: 1 for e in session_load.ENTITIES}
    synced = {r["entity"]: (r["cursor"] is not None, r["complete"], r["last_error"]) for r in session_load.table(spark, root, "sync").collect()}
    assert synced["Measures"] == (True, True, None) and synced["FloorLetters"] == (False, True, None)
    broken = spark.createDataFrame([("s", "Measures", "timeout")], "session_key string, entity string, error string")
    assert load(2, failures=broken)
    assert {n: session_load.table(spark, root, n).count() for n in ("Committees", "Measures", "FloorLetters")} == {"Committees": 1, "Measures": 0, "FloorLetters": 0}
    assert session_load.table(spark, root, "sessions").first()["stopped_at"] == "Measures" and session_load.table(spark, root, "Measures", run_id=1).count() == 1


def test_a_sibling_hides_no_document(spark, tmp_path):
    docs = spark.createDataFrame([(f"7-{k}", 7, k, "floor_letter", "failed_retryable", "https://x", "active") for k in (1, 2, 3)], "doc_key string, bill_id long, source_id int, document_kind string, download_status string, canonical_download_url string, source_presence string")
    docs = docs.withColumn("first_seen_at", F.to_timestamp(F.lit("2020-01-01")))
    bills = spark.createDataFrame([(7, "2021R1")], "bill_id long, session_key string")
    scope, states = spark.createDataFrame([("2021R1", 1)], "session_key string, ordinal int"), spark.createDataFrame([("2021R1", "inventory_complete")], "session_key string, inventory_status string")
    source = spark.createDataFrame([("document", "7-1"), ("document", "7-2"), ("bill", "7")], "item_type string, item_key string")
    items = archive.retry_items(5, docs, bills, 2014, True, source, session=" 2021r1 ", bill=7)
    assert sorted(r["item_key"] for r in items.collect()) == ["7-1", "7-2"]
    left = archive.work_list(scope, states, docs, bills, items, _now(), ["failed_retryable"], ["floor_letter"])
    assert [r["doc_key"] for r in left.collect()] == ["7-3"]
    assert archive.publish_list(items, ["item_key"], str(tmp_path), 5) and not archive.publish_list(items.limit(1), ["item_key"], str(tmp_path), 5)
    assert [(r["item_key"], r["position"]) for r in archive.listed(spark, str(tmp_path), 5, after=0).collect()] == [("7-2", 1)]


def test_download_states_of_each_kind(spark):
    docs = spark.createDataFrame([("skip", "downloaded", "valid", True, False, None), ("changed", "downloaded", "valid", True, True, None), ("lost", "downloaded", "valid", False, False, None), ("kept", "failed_terminal", "invalid", None, None, "404"), ("wait", "discovered", "not_validated", None, None, None), ("bad", "queued", "not_validated", None, None, None)], "doc_key string, download_status string, validation_status string, file_valid boolean, source_changed boolean, last_error string")
    tries = spark.createDataFrame([("changed", 1, False, "timeout", True, "t"), ("changed", 2, True, None, None, None), ("lost", 1, False, "low_space", True, "disk"), ("kept", 1, True, None, None, None), ("bad", 1, False, "validation_failed", False, "no pdf")], "doc_key string, attempt int, ok boolean, code string, retryable boolean, message string")
    got = {r["doc_key"]: tuple(r)[1:] for r in archive.download_states(docs, tries, False).collect()}
    assert got == {
        "skip": (None, "downloaded", "valid", "skipped", None, False),
        "changed": ("changed_remote", "downloaded", "valid", "completed", None, False),
        "lost": ("missing_local", "paused_low_space", "not_validated", "paused_low_space", "disk", False),
        "kept": (None, "failed_terminal", "invalid", "failed_terminal", "404", True),
        "wait": ("discovered", "queued", "not_validated", "queued", None, False),
        "bad": ("queued", "failed_terminal", "invalid", "failed_terminal", "no pdf", False),
    }
    again = {r["doc_key"]: (r["queued_from"], r["status"], r["preserved"]) for r in archive.download_states(docs, tries, True).collect()}
    assert again["kept"] == ("failed_retryable", "downloaded", False)


def test_runs_without_a_count_of_bills(spark):
    runs = spark.createDataFrame([(1, None, "boom"), (2, 0, "boom"), (3, 1, "boom"), (4, None, None)], "run_id int, bills_completed int, fatal_error string")
    runs = runs.withColumns({"status": F.lit("running"), "run_type": F.lit("x"), "error_count": F.lit(0), "sessions_incomplete": F.lit(0), "sessions_failed": F.lit(0)})
    items = spark.createDataFrame([], "run_id int, item_type string, status string")
    assert {r[0]: r[1] for r in rollups.finished_runs(runs, items, ["y"]).collect()} == {1: "failed", 2: "failed", 3: "completed", 4: "completed"}


def test_paths_are_decoded_and_normal(spark):
    paths = {"/a/./b//../c/": "/a/c", "a/../../b": "../b", "/../a": "/a", "\\a\\b": "/a/b", "": ".", "//h/a": "//h/a", "///a": "/a", "..": "..", "a/..": ".", "/": "/"}
    rows = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    assert [r[0] for r in rows.select(routes.normal_path(F.col("p"))).collect()] == [*paths.values(), None]
    coded = spark.createDataFrame([("a%252525%2B+%zz",), ("%25252541",), ("%252541",), ("%2541",)], "p string")
    assert [r[0] for r in coded.select(routes.decoded(F.col("p"))).collect()] == ["a%252525%2B+%zz", "%41", "A", "A"]


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b":1, "a":2}',), ('say "x"',), (None,), ("12",)], "t string")
    assert [r[0] for r in rows.select(text.canonical_text(F.col("t"))).collect()] == ['{"b":1, "a":2}', '"say \\"x\\""', None, "12"]
    value = F.struct(F.lit(1).alias("z"), F.create_map(F.lit("é"), F.lit(None).cast("int"), F.lit("a"), F.lit(2)).alias("m"), F.to_timestamp(F.lit("2024-01-02 03:04:05.5")).alias("at"))
    assert spark.range(1).select(text.canonical_value(value)).first()[0] == '{"at":"2024-01-02T03:04:05.500000","m":{"a":2,"é":null},"z":1}'


def test_priority_of_display_statuses(spark):
    rows = [("a", "checked_zero"), ("a", "failed_fetch"), ("b", "checked_zero"), ("b", "checked_with_records"), ("c", None), ("d", "not_applicable"), ("e", "parser_anomalous"), ("e", "checked_with_records")]
    got = dict(map(tuple, display.display_status(spark.createDataFrame(rows, "session_key string, status string")).collect()))
    assert got == {"a": "failed_fetch", "b": "checked_with_records", "c": "not_applicable", "d": "not_applicable", "e": "parser_anomalous"}
