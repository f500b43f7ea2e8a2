"""Audit exports and appended ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import csv_safe


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header behind a byte order mark, CRLF, quoted as needed, nulls empty, no formulas."""
    first, *rest = rows.columns
    cells = rows.select(csv_safe(F.col(first)).alias("﻿" + first), *[csv_safe(F.col(c)).alias(c) for c in rest])
    cells.write.csv(path, header=True, lineSep="\r\n", nullValue="", emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_fetches(fetches: DataFrame, path: str, allowed: list[str]) -> None:
    """Append allowed columns of fetch records to the ledger."""
    fetches.select(*[c for c in allowed if c in fetches.columns]).write.mode("append").parquet(path)
