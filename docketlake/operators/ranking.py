"""Row-relative operators: latest and first rows, conflicts, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; give an order that leaves no ties."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def first_wins(rows: DataFrame, keys: list[str], ordinal: str, content: list[str]) -> DataFrame:
    """First row of each key by arrival, with n_rows and whether rows of the key differ in content.

    One grouped aggregate with map-side combine; no window, so a hot key is no hot task.
    """
    value = F.struct(ordinal, *content)
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    found = rows.groupBy(*keys).agg(F.min(value).alias("first"), F.count("*").alias("n_rows"), (F.min(digest) != F.max(digest)).alias("conflict"))
    return found.select(*keys, "first.*", "n_rows", "conflict")


def streaks(rows: DataFrame, key: str, order: str, failed: Column, least: int) -> DataFrame:
    """Runs of at least `least` consecutive failures of a key: (key, start, end, n)."""
    by = Window.partitionBy(key).orderBy(order)
    islands = rows.select(key, order, failed.alias("f")).withColumn("island", F.sum(F.when(F.col("f"), 0).otherwise(1)).over(by))
    return islands.where("f").groupBy(key, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def next_versions(new: DataFrame, known: DataFrame) -> DataFrame:
    """Version numbers for (document, sha256, seen): a known or repeated hash keeps its version, others follow the largest in order of arrival; rows without a hash are always new."""
    tops = known.groupBy("document").agg(F.max("version").alias("top"))
    same = known.where("sha256 is not null").groupBy("document", "sha256").agg(F.min("version").alias("old"))
    distinct = new.groupBy("document", "sha256", F.when(F.col("sha256").isNull(), F.col("seen")).alias("own")).agg(F.min("seen").alias("seen")).drop("own")
    marked = distinct.join(same, ["document", "sha256"], "left")
    fresh = marked.where("old is null").join(tops, "document", "left")
    numbered = fresh.withColumn("version", F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("document").orderBy("seen")))
    return numbered.select("document", "sha256", "version", F.lit(True).alias("is_new")).union(marked.where("old is not null").select("document", "sha256", "old", F.lit(False)))
