"""Queries on tables whose keys and rows go beyond those of the given ones, against their SQL."""

import os

import duckdb
import pytest

from docketlake.plans import registry

SF = "/root/testdata/sf0.001"
SHIFTS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "pages": "page_id"}


@pytest.fixture
def larger(tmp_path):
    """larger(table, times, by): the smallest tables, one of them repeated with its key shifted by `by` each time."""

    def make(table, times, by):
        db = duckdb.connect()
        for f in os.listdir(SF):
            if f[:-8] != table:
                os.symlink(f"{SF}/{f}", tmp_path / f)
        key = SHIFTS[table]
        db.execute(f"COPY (SELECT t.* REPLACE ({key} + {by} * i AS {key}) FROM '{SF}/{table}.parquet' t, range({times}) r(i)) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def _match(spark, name, sf):
    frame = registry.QUERIES[name](spark, sf)
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    result = db.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(map(repr, map(tuple, frame.select(*[f"`{c}`" for c in names]).collect()))) == sorted(map(repr, want)) and want


def test_chains_are_bounded_one_by_one(spark, larger):
    n = duckdb.connect().execute(f"SELECT count(*) FROM '{SF}/pages.parquet'").fetchall()[0][0]
    _match(spark, "a2_page_chain", larger("pages", 10_000 // n + 2, n))


def test_a_long_chain_is_found(spark):
    from docketlake.sources import pages

    rows = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", None, 1), ("d", None, 2)], "url string, next_url string, chain long")
    assert [r["n"] for r in pages.audit_page_chain(rows, 2).where("finding = 'too_long'").collect()] == [3]
    assert [r["n"] for r in pages.audit_page_chain(rows.drop("chain"), 2).where("finding = 'too_long'").collect()] == [4]


def test_raw_measures_with_long_numbers(spark, larger):
    _match(spark, "b5_raw_json", larger("orders", 2, 999_000))


def test_rejected_measures_with_long_numbers(spark, larger):
    _match(spark, "b5_rejected_measures", larger("orders", 2, 999_000))


def test_no_measure_is_lost(spark, larger):
    from docketlake.functions import mapping
    from docketlake.plans.standins import Tables

    rows = Tables(spark, larger("orders", 2, 999_000)).rawmeasure
    parts = [f.count() for f in (mapping.measures(rows, ""), mapping.rejected_measures(rows), mapping.unnumbered_measures(rows))]
    assert sum(parts) == rows.count() and min(parts) > 0


def test_lines_are_told_apart_before_their_text_is_made(spark, tmp_path):
    from docketlake.plans.standins import VIEWS, Tables

    a = "1::bigint AS l_orderkey, {} AS l_partkey, 6::bigint AS l_suppkey, 1::int AS l_linenumber, TIMESTAMP '1995-01-01' AS l_shipdate"
    rows = [a.format(p) for p in ("5::bigint", "5::bigint", "10::bigint")] + [a.format(p).replace("1::bigint", "NULL::bigint", 1) for p in ("20::bigint", "40::bigint")]
    duckdb.connect().execute(f"COPY ({' UNION ALL '.join('SELECT ' + r for r in rows)}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    t = Tables(spark, str(tmp_path))
    want = sorted(map(repr, spark.sql(VIEWS["rawdoc"].format(**t.names)).collect()))
    assert len(want) == 3 and sorted(map(repr, t.rawdoc.collect())) == want
    assert "Aggregate [l_orderkey" in t.rawdoc._jdf.queryExecution().optimizedPlan().toString()


def test_metadata_is_parsed_once(spark):
    from docketlake.sources import contract

    rows = spark.createDataFrame([(1, "<x><DataServices/></x>"), (2, "<x"), (3, None), (4, " ")], "id long, xml string")
    frame = contract.report(rows, "id", "xml", {"A": "B"})
    assert sorted((r["id"], r["finding"]) for r in frame.collect()) == [(1, "missing_entity_set"), *((k, "metadata_parse_error") for k in (2, 3, 4))]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan


def test_plain_markup_is_read_in_one_loop():
    import sys

    from docketlake.sources import html_tables as H

    rows = 200
    page = "<h2>Testimony</h2><table><tr><th>Title</th></tr>" + "".join(f"<tr><td><a href='/Downloads/X/{k}'>A &amp; &lt;{k}</a></td></tr>" for k in range(rows)) + "</table>"
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    try:
        read, error = H.read_tables(page)
    finally:
        sys.setprofile(None)
    assert error is None and [r["cells"]["title"] for r in read.rows] == [f"A & <{k}" for k in range(rows)]
    assert len(calls) < 10 * rows  # a call a tag and text made 14 for each row


def test_records_of_both_families_are_joined_once_by_their_columns(spark):
    plan = registry.QUERIES["s20_both_families"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "to_json" not in plan
    kept = [line for line in plan.split("\n") if "InMemoryRelation" in line and "reclassified#" in line]
    assert len(kept) == 3  # records, single findings and counts read what is kept


def test_of_rows_of_one_page_the_proof_counts(spark):
    from docketlake.sources import html_tables as H

    page = "<h2>Testimony</h2><table><tr><th>Title</th></tr><tr><td><a href='/Downloads/X/1'>a</a></td></tr></table>"
    pages = [(1, page), (2, "<p>x</p>"), (3, "<a href='/Downloads/X/9'>x</a>"), (3, page), (4, "<h2>Testimony</h2>No items to display")]
    rows = H.identities_of(H.check_pages(H.parse_pages(spark.createDataFrame(pages, "page_id long, html string"))), ["checked_with_records", "checked_zero"])
    assert {r["page_id"]: r["outcome"] for r in rows.collect()} == {1: "checked_with_records", 2: "parser_anomalous", 3: "checked_with_records", 4: "checked_zero"}
    assert [f.name for f in rows.schema["records"].dataType.elementType.fields] == ["family", "source_id", "conflict"]


def test_records_are_told_apart_by_numbers(spark):
    plan = registry.QUERIES["s20_reconcile_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(outcome" not in plan and all("record#" not in line for line in plan.split("\n") if "Join" in line)


def test_a_source_is_read_once_for_a_load(spark, monkeypatch):
    from docketlake.operators import session_load

    class Seen(Exception):
        pass

    def problems(rows, *_):
        raise Seen(rows.inputFiles())

    monkeypatch.setattr(session_load, "load_problems", problems)
    with pytest.raises(Seen) as seen:
        registry.QUERIES["r11_session_load"](spark, SF)
    files = seen.value.args[0]
    assert any("/read-Legislators/" in f for f in files) and all("/data/" in f for f in files)  # what the run has written


def test_all_families_of_documents_are_made_at_once(spark):
    from docketlake.plans import load_queries as L
    from docketlake.plans.standins import Tables

    t = Tables(spark, SF)
    made = spark.sql(L._LANDED.format(**t.names)).cache()
    for name, flag in L._FLAGS.items():
        want = spark.sql(L.SOURCES[name].format(**t.names))
        got = made.where(f"f = '{flag}'").drop("f")
        assert got.schema == want.schema and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty(), name
    made.unpersist()
