"""Landed source pages: envelope scan, chain audit, scoped reads, catalogue and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.records import session_key
from docketlake.functions.text import blank

#: Names of the next link and of the count in an envelope.
NEXT_LINKS = ("odata.nextLink", "@odata.nextLink", "__next", "nextLink", "next")
COUNTS = ("odata.count", "@odata.count", "count")


def read_pages(spark: SparkSession, path: str, item_schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, pages) of page files: items under value, else results, possibly inside d; next link and count under any of their names.

    pages: file, next_link, n_items, total, error; a page without a list of objects is an error and has no rows.
    rows: file, position, item.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.input_file_name().alias("file"))
    parsed = text.withColumn("v", F.try_parse_json("body"))
    inner = F.coalesce(F.try_variant_get("v", "$.d", "variant"), F.col("v"))
    pick = lambda names, kind: F.coalesce(*[F.try_variant_get(at, f"$['{n}']", kind) for n in names for at in (F.col("v"), inner)])
    items = F.coalesce(F.try_variant_get("v", "$.value", "array<variant>"), F.try_variant_get(inner, "$.value", "array<variant>"), F.try_variant_get(inner, "$.results", "array<variant>"), F.try_variant_get("v", "$.d", "array<variant>"))
    odd = F.exists("items", lambda x: ~F.schema_of_variant(x).startswith("OBJECT"))
    error = F.when(F.col("v").isNull(), "not json").when(F.col("items").isNull(), "no list of items").when(odd, "an item is no object")
    pages = parsed.withColumn("items", items).withColumn("error", error).withColumn("next_link", pick(NEXT_LINKS, "string")).withColumn("total", pick(COUNTS, "bigint"))
    rows = pages.where("error is null").select("file", F.posexplode("items").alias("position", "x")).select("file", "position", F.from_json(F.to_json("x"), item_schema).alias("item"))
    return rows, pages.select("file", "next_link", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), "total", "error")


def audit_page_chain(pages: DataFrame, longest: int = 10_000) -> DataFrame:
    """(url, finding, n): dangling next links, pages linked more than once, pages that nothing links to, and a chain that is too long.

    pages: url, next_url[, chain]. A sound chain has one unlinked page, its first. A loop shows as a page linked
    twice or as no unlinked page at all. `longest` bounds each chain, the pages of one read; without the column all pages are one.
    """
    targets = pages.where("next_url is not null").groupBy(F.col("next_url").alias("url")).agg(F.count("*").alias("n"))
    urls = pages.groupBy("url").agg(F.count("*").alias("pages"))
    both = urls.join(targets, "url", "full_outer")
    finding = F.when(F.col("pages").isNull(), "dangling").when(F.col("n") > 1, "linked_twice").when(F.col("pages") > 1, "repeated_page").when(F.col("n").isNull(), "unlinked")
    found = both.select("url", finding.alias("finding"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("finding is not null")
    sizes = pages.groupBy("chain") if "chain" in pages.columns else pages
    size = sizes.agg(F.count("*").alias("n")).where(F.col("n") > longest).select(F.lit(None).cast("string").alias("url"), F.lit("too_long").alias("finding"), "n")
    return found.unionByName(size)


def scoped_read(rows: DataFrame, session: str, prefixes: list[str], cursor: str | None, modified_col: str | None, force_full: bool = False) -> tuple[DataFrame, bool]:
    """(rows in scope, whether absence is proof): rows of a session and its prefixes, from the cursor on if one is kept (inclusive on purpose)."""
    scope = rows.where((F.col("session_key") == session) & F.col("measure_prefix").isin(prefixes))
    if cursor is None or modified_col is None or force_full:
        return scope, True
    return scope.where(F.col(modified_col) >= F.lit(cursor).cast("timestamp")), False


def scope_violations(rows: DataFrame, session: str, prefixes: list[str]) -> DataFrame:
    """(reason, n) of rows outside the plan; a load with any must fail and move no cursor."""
    reason = F.when(~F.col("session_key").eqNullSafe(session), "session").when(~F.coalesce(F.col("measure_prefix").isin(prefixes), F.lit(False)), "prefix")
    return rows.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def resolve_catalogue(sessions: DataFrame) -> DataFrame:
    """Every catalogue row with its normal key, parsed date and compatibility_issue (messages joined by "; "); n_same counts its key."""
    key, date = session_key(F.col("session_key")), F.try_to_timestamp("begin_date")
    issues = F.concat_ws(
        "; ",
        F.when(blank(F.col("session_key")), "no session key").when(key.isNull(), "session key is not in the modern format"),
        F.when(blank(F.col("begin_date")), "no begin date").when(date.isNull(), "begin date is not supported"),
    )
    counted = sessions.groupBy(session_key(F.col("session_key")).alias("k")).agg(F.count("*").alias("n_same")).where("k is not null")
    return sessions.select("session_key", "begin_date", key.alias("normal_key"), date.alias("begin_at"), F.when(issues != "", issues).alias("compatibility_issue")).join(counted, F.col("normal_key") == F.col("k"), "left").drop("k")


def select_range(catalogue: DataFrame, first: str, last: str) -> DataFrame:
    """Sessions from one to another, inclusive, by date and key; nothing if either end is unknown or they are reversed."""
    at = lambda key, a, b: catalogue.where(F.col("session_key") == key).select(F.col("begin_date").alias(a), F.col("session_key").alias(b)).limit(1)
    ends = at(first, "d1", "k1").crossJoin(at(last, "d2", "k2"))  # one row
    order = F.struct("begin_date", "session_key")
    return catalogue.crossJoin(F.broadcast(ends)).where((order >= F.struct("d1", "k1")) & (order <= F.struct("d2", "k2"))).drop("d1", "k1", "d2", "k2")


def check_contract(required: DataFrame, actual: DataFrame) -> DataFrame:
    """(entity, property, finding): required properties that are missing, as a whole entity set where none of it is there."""
    sets = actual.select(F.col("entity").alias("e")).distinct()
    missing = required.join(actual, ["entity", "property"], "left_anti").join(sets, F.col("entity") == F.col("e"), "left")
    whole = missing.where("e is null").select("entity", F.lit(None).cast("string").alias("property"), F.lit("missing_entity_set").alias("finding")).distinct()
    return whole.unionByName(missing.where("e is not null").select("entity", "property", F.lit("missing_property").alias("finding")))


def first_alias(names: list[str], columns: list[str]) -> Column:
    """The first of several names that a table has, else null."""
    return next((F.col(n) for n in names if n in columns), F.lit(None))


def project_allowed(df: DataFrame, aliases: dict[str, str], allowed: list[str]) -> DataFrame:
    """Only allowed columns; a target that is absent is filled from its alias."""
    names = {target: alias for alias, target in aliases.items() if target not in df.columns and alias in df.columns}
    return df.select(*[F.col(c) if c in df.columns else F.col(names[c]).alias(c) for c in allowed if c in df.columns or c in names])
