"""Every registered query against its SQL on the smallest tables, and what operators do on small literal rows."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docketlake.functions import records, text
from docketlake.operators import ledgers, merge, searches
from docketlake.plans import registry
from docketlake.sources import exports, html_tables, pages
from docketlake.streaming import loads

SF = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") and value.tzinfo else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(_plain(v) for v in r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    result = db.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_contains_keeps_wildcards_and_backslashes(spark):
    rows = spark.createDataFrame([("A_b\\C",), ("axb",), (None,)], "x string")
    assert [r[0] for r in rows.select(text.contains(F.col("x"), "a_B")).collect()] == [True, True, False]
    assert [r[0] for r in rows.select(text.contains(F.col("x"), "b\\c")).collect()] == [True, False, False]


def test_retry_after_and_dates(spark):
    rows = spark.createDataFrame([("120",), ("Sat, 01 Jun 2024 00:01:00 GMT",), ("soon",)], "x string")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    assert [r[0] for r in rows.select(records.retry_after_seconds(F.col("x"), now)).collect()][:2] == [120.0, 60.0]


def test_names_are_in_compatibility_form(spark):
    rows = spark.createDataFrame([("ﬁle Ａ.pdf",), ("e\u0301.pdf",), (None,)], "x string")
    assert [r[0] for r in rows.select(records.nfkc(F.col("x"))).collect()] == ["file A.pdf", "\u00e9.pdf", None]


def test_read_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"odata.metadata": "m", "value": [{"k": "a"}, {"k": "b"}], "odata.nextLink": "p2"}')
    (tmp_path / "2.json").write_text('{"d": {"results": [{"k": "c"}], "__next": null}, "odata.count": "7"}')
    (tmp_path / "3.json").write_text('{"value": 3}')
    (tmp_path / "4.json").write_text("no json")
    rows, found = pages.read_pages(spark, str(tmp_path), "k string")
    assert sorted(r["item"]["k"] for r in rows.collect()) == ["a", "b", "c"]
    by = {r["file"][-6]: r for r in found.collect()}
    assert by["1"]["next_link"] == "p2" and by["2"]["total"] == 7 and by["3"]["error"] == "no list of items" and by["4"]["error"] == "not json"


def test_html_pages(spark):
    table = "<h2>Testimony</h2><table><tr><th>Title</th><th>Position</th></tr><tr><td><a href='/Downloads/PublicTestimony/12'>A  b</a></td><td>Support</td></tr>{}</table>"
    rows = [
        (1, table.format("")),
        (2, table.format("<tr><td><a href='/Downloads/PublicTestimony/12'>Other</a></td><td>Oppose</td></tr>")),
        (3, "<h2>Testimony</h2><p>No items to display.</p>"),
        (4, "<h2>Testimony</h2><a href='/Downloads/PublicTestimony/9'>x</a>"),
        (5, None),
    ]
    parsed = html_tables.parse_pages(spark.createDataFrame(rows, "page_id long, html string"))
    assert {r["page_id"]: r["outcome"] for r in html_tables.classify_pages(parsed).collect()} == {1: "checked_with_records", 2: "parser_anomalous", 3: "checked_zero", 4: "parser_anomalous", 5: "parser_anomalous"}
    assert [(r["source_id"], r["title"], r["position"]) for r in html_tables.extract_rows(parsed).where("page_id = 1").collect()] == [(12, "A b", "Support")]


def test_replayed_ledger_batch_counts_once(spark):
    empty = spark.createDataFrame([], "fingerprint string, first_seen long, last_seen long, occurrences long, resolved_at long, message string, last_batch int")
    seen = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "fingerprint string, at long, message string")
    once = merge.ledger_merge(empty, seen, batch=0)
    assert merge.ledger_merge(once, seen, batch=0).first()["occurrences"] == 2
    assert merge.ledger_merge(once, seen, batch=1).first()["occurrences"] == 4


def test_export_is_safe_for_spreadsheets(spark, tmp_path):
    exports.export_csv(spark.createDataFrame([("=1+1", None), (" ok ", 2)], "a string, b int").coalesce(1), str(tmp_path / "x"))
    data = next((tmp_path / "x").glob("part-*")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and b"'=1+1" in data and b"\r\n" in data and b" ok " in data


def test_incremental_load_is_idempotent(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    run = lambda: loads.incremental_load(spark, str(landing), "k long, v string", ["k"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (landing / "2.json").write_text('{"k": 2, "v": "d"}\n{"k": 2, "v": "c"}\n')
    run()
    run()
    root = str(tmp_path / "out")
    held = lambda: sorted(tuple(r) for r in loads.latest_snapshot(spark, root).collect())
    assert held() == [(1, "a"), (2, "c")] and len(list((tmp_path / "out" / "current").iterdir())) == 2
    spark.range(3).write.parquet(f"{root}/data/9-lost")  # a batch that was lost before it was published
    assert held() == [(1, "a"), (2, "c")]
    assert any("9-lost" in p for p in loads.vacuum(spark, root, keep=1)) and held() == [(1, "a"), (2, "c")]
    assert len(list((tmp_path / "out" / "current").iterdir())) == 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text("".join(f'{{"k": {k}, "v": "a"}}\n' for k in range(200)))
    run = lambda: loads.incremental_load(spark, str(landing), "k long, v string", ["k"], str(tmp_path / "out"), str(tmp_path / "cp"), buckets=16).awaitTermination()
    run()
    (landing / "2.json").write_text('{"k": 7, "v": "b"}\n')
    run()
    written = {p.name.split("-")[0]: len(list(p.glob("bucket_=*"))) for p in (tmp_path / "out" / "data").iterdir()}
    assert written["0"] == 16 and written["1"] == 1
    assert {r["v"] for r in loads.latest_snapshot(spark, str(tmp_path / "out")).where("k <> 7").collect()} == {"a"} and loads.latest_snapshot(spark, str(tmp_path / "out")).count() == 200


def test_measures_that_contradict_themselves(spark):
    rows = [("HB", 1, "hb 1", None, None), ("HB", 2, "HB3", "House", None), ("SB", 3, None, "House", "Bill"), ("XX", 4, None, None, None), ("SB", 5, "sb-05", " Senate ", "Petition"), ("SB", 6, None, "Senate", "Bill")]
    frame = spark.createDataFrame(rows, "measure_prefix string, measure_number long, bill_id_compact string, bill_chamber string, measure_type string")
    got = {r["measure_number"]: (r["problem"], r["bill_id_compact"]) for r in ledgers.checked_bills(frame).collect()}
    assert got == {1: (None, "HB1"), 2: ("identity", "HB3"), 3: ("chamber", None), 4: ("identity", None), 5: ("type", "sb-05"), 6: (None, "SB6")}


def test_scope_that_does_not_widen_changes_nothing(spark):
    sync = spark.createDataFrame([("1999R1", "Measures", 5, 4, 3, "complete", True)], "session_key string, entity string, cursor long, last_full_at long, last_successful_run_id long, outcome string, complete boolean")
    state = spark.createDataFrame([("1999R1", "inventory_complete")], "session_key string, inventory_status string")
    same = ledgers.invalidate_scope(sync, state, ["HB", "SB"], ["SB"], ["Measures"])
    assert same == (sync, state)


def test_views_of_operations(spark):
    assert set(searches.FEED) == set(registry.QUERIES["h1_operations_feed"](spark, SF).columns) and len(searches.FEED) == 19


def test_entry_point_hides_no_broken_dependency(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "docketlake.llm", None)
    monkeypatch.delitem(sys.modules, "docketlake.llm.queries", raising=False)
    monkeypatch.delattr("docketlake.llm", raising=False)
    assert not any(q.startswith("op") for q in importlib.reload(entry).queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_streaks_follow_the_order_of_events_over_files_and_ranges(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.random() < 0.9) for i in range(600)]
    for k, a in enumerate((400, 0, 200)):  # files in another order than events
        spark.createDataFrame(rows[a : a + 200], "k long, i long, bad boolean").coalesce(1).write.parquet(str(tmp_path / str(k)))
    stream = spark.readStream.schema("k long, i long, bad boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    found = loads.outage_streaks(stream, "k", "i", "bad")
    assert not found.isStreaming and "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    want, n = [], {}
    for k, i, bad in rows:
        n[k] = n.get(k, 0) + 1 if bad else 0
        if n[k] >= 3:
            want.append((k, i, n[k]))
    assert sorted(map(tuple, found.collect()), key=lambda x: x[1]) == want


def test_plans_have_no_cartesian_product(spark):
    plan = registry.QUERIES["e1_session_status"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
