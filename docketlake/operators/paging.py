"""Sorting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sort names and their terms; the direction goes to the last term only, and the id breaks ties.
BILL_SORTS = {"bill": ("session_key", "measure_prefix", "measure_number"), "title": ("bill_title",), "modified": ("source_modified_at",), "session": ("session_key",)}


def bill_order(name: str, descending: bool) -> list[Column]:
    if name not in BILL_SORTS:
        raise ValueError(f"unknown sort {name!r}")
    *first, last = (F.col(c).try_cast("bigint") if c == "measure_number" else F.col(c) for c in BILL_SORTS[name])
    return [*(c.asc_nulls_first() for c in first), last.desc_nulls_last() if descending else last.asc_nulls_first(), F.col("bill_id").asc()]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of 1 to 500 rows."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def keyset_page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def with_total(page_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """A page with the exact number of rows that the filter has."""
    return page_rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


#: Orders of lists by name: columns, with - before those that descend. Ascending ones have nulls first, descending ones last.
ORDERS = {
    "sessions": "-begin_date -session_key",
    "legislators": "session_key last_name first_name legislator_code",
    "committees": "session_key committee_name committee_code",
    "bill_documents": "bill_id document_kind meeting_date source_id",
    "versions": "document -version",
}


def named_order(order: str) -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_first() for c in order.split()]
