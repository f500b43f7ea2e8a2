"""Text helpers as Column expressions: cleaning, containment, matching, fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_ascii(value: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(value, _UPPER, _LOWER)


def contains(value: Column, needle: str) -> Column:
    """Case-blind (ASCII) containment in which % and _ of the needle stay wildcards and a backslash is itself."""
    pattern = F.lit("%" + needle.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%")
    return F.like(F.coalesce(fold_ascii(value), F.lit("")), pattern)


def contains_any(values: list[Column], needle: str | None) -> Column:
    """Whether any of the columns contains the needle; no needle filters nothing."""
    if not needle:
        return F.lit(True)
    found = F.lit(False)
    for v in values:
        found = found | contains(v, needle)
    return found


def strip(value: Column) -> Column:
    """Without white space at the ends; blank becomes null."""
    out = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(out != "", out)


def collapse(value: Column) -> Column:
    """Inner white space as one space, none at the ends; blank becomes null."""
    return strip(F.regexp_replace(value, r"\s+", " "))


def blank(value: Column) -> Column:
    """Null, or nothing but spaces."""
    return F.coalesce(F.trim(value), F.lit("")) == ""


def parse_bool(value: Column, letters: bool = True) -> Column:
    """true/1/yes and false/0/no (with letters also y and n); anything else is unknown."""
    text = F.lower(F.trim(value))
    yes, no = ["true", "1", "yes"], ["false", "0", "no"]
    if letters:
        yes, no = [*yes, "y", "t"], [*no, "n", "f"]
    return F.when(text.isin(yes), True).when(text.isin(no), False)


def parse_int(value: Column) -> Column:
    """A whole number with an optional sign, else null."""
    text = F.trim(value)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def fingerprint(parts: list[Column], separator: str = "\u001f") -> Column:
    """SHA-256 of the parts as text, nulls as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in order, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_value(value: Column) -> Column:
    """Compact JSON of a struct, map or array with the keys of every level in order, nulls kept, dates and times in ISO form.

    Keys are put in order by the variant type, by their UTF-8 bytes; equal values give equal text in whatever order their maps stand.
    """
    plain = F.to_json(value, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})
    return F.to_json(F.parse_json(F.regexp_replace(plain, r"(\d{2}:\d{2}:\d{2})\.000000\"", '$1"')))


def canonical_text(value: Column) -> Column:
    """Text that is JSON stays as it is, to the byte; other text becomes a JSON string; null is null."""
    quoted = F.to_json(F.array(value))
    return F.when(F.try_parse_json(value).isNotNull(), value).when(value.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def csv_safe(value: Column) -> Column:
    """Text for a spreadsheet: null is empty, and what could be read as a formula gets a leading apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def yes_no_unknown(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value, "yes").otherwise("no")
