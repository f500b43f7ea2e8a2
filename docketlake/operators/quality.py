"""Audits: constraints, uniqueness, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.records import prefix_chamber


def constraint_audit(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of all rules in one pass; a rule is a condition that must not be false (null passes, as in SQL)."""
    counts = rows.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.rule", "x.violations")


def uniqueness_audit(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys with more than one row; with a condition, among the rows that meet it."""
    return (rows if where is None else rows.where(where)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphan_audit(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is not null and has no parent."""
    known = parents.select(F.col(parent_key).alias("known_")).distinct()
    return children.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("known_"), "left_anti")


#: Kinds of documents.
DOCUMENT_KINDS = ["public_testimony", "legacy_testimony", "committee_presentation", "floor_letter", "committee_document_other", "unknown"]


def domain_rules(enums: dict[str, list[str]], texts: list[str], counts: list[str], hashes: list[str]) -> dict[str, Column]:
    """Rules for constraint_audit(): values of a fixed set, text that is not blank, counts that are not negative, hashes of 64 lower-case hex digits."""
    rules = {c: F.col(c).isin(values) for c, values in enums.items()}
    rules |= {f"{c} is not blank": F.trim(c) != "" for c in texts}
    rules |= {f"{c} is not negative": F.col(c) >= 0 for c in counts}
    return rules | {f"{c} has 64 hex digits": F.col(c).rlike("^[0-9a-f]{64}$") for c in hashes}


def prefix_fits(prefix: Column, chamber: Column) -> Column:
    """Whether a measure's chamber is that of its prefix."""
    return prefix_chamber(prefix) == chamber
