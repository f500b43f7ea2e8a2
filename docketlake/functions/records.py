"""Normalisation of measures, sponsors, documents, dates, URLs and files as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import blank, collapse, fold_ascii

#: Measure prefixes, their chamber and their meaning.
PREFIXES = {
    "HB": ("House", "Bill"), "SB": ("Senate", "Bill"), "HJR": ("House", "Joint Resolution"), "SJR": ("Senate", "Joint Resolution"),
    "HCR": ("House", "Concurrent Resolution"), "SCR": ("Senate", "Concurrent Resolution"), "HR": ("House", "Resolution"), "SR": ("Senate", "Resolution"),
    "HJM": ("House", "Joint Memorial"), "SJM": ("Senate", "Joint Memorial"), "HM": ("House", "Memorial"), "SM": ("Senate", "Memorial"),
}
#: Position codes of testimony.
POSITIONS = {3981: "Neutral", 3982: "Oppose", 3983: "Support"}
#: MIME types and their file extensions.
EXTENSIONS = {"application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/tiff": ".tif", "text/html": ".html", "application/zip": ".zip", "application/msword": ".doc", "application/rtf": ".rtf", "text/plain": ".txt"}
#: Extensions that stand for the same type.
ALIASES = {".jpeg": ".jpg", ".tiff": ".tif", ".htm": ".html"}


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def session_key(value: Column) -> Column:
    """Session key without white space, upper-cased; null unless well formed."""
    key = F.upper(F.regexp_replace(value, r"\s+", ""))
    return F.when(key.rlike(r"^20\d{2}[A-Z][A-Z0-9]{0,4}$"), key)


def bill_parts(value: Column, digits: str = "{1,6}") -> Column:
    """struct(prefix, number, compact, display) of a bill id as people write it; null unless well formed. `digits`: how many its number may have."""
    pattern = r"(?i)^\s*(" + "|".join(sorted(PREFIXES, key=len, reverse=True)) + r")\s*[- ]?\s*(\d" + digits + r")\s*$"
    prefix, number = F.upper(F.regexp_extract(value, pattern, 1)), F.regexp_extract(value, pattern, 2).try_cast("bigint").cast("string")
    return F.when(value.rlike(pattern), F.struct(prefix.alias("prefix"), number.alias("number"), F.concat(prefix, number).alias("compact"), F.concat_ws(" ", prefix, number).alias("display")))


def prefix_chamber(prefix: Column) -> Column:
    return _lookup(F.upper(prefix), {k: v[0] for k, v in PREFIXES.items()})


def prefix_meaning(prefix: Column) -> Column:
    return _lookup(F.upper(prefix), {k: v[1] for k, v in PREFIXES.items()})


def chamber_name(code: Column) -> Column:
    key = F.upper(F.trim(code))
    return F.when(key.isin("H", "HOUSE"), "House").when(key.isin("S", "SENATE"), "Senate")


def sponsor_level(level: Column) -> Column:
    text = F.lower(F.trim(level))
    return F.when(text.startswith("chief"), "chief").when(text.startswith("regular"), "regular").otherwise("unknown")


def sponsor_kind(legislator: Column, committee: Column) -> Column:
    return F.when(~blank(legislator), "legislator").when(~blank(committee), "committee").otherwise("other")


def position(value: Column) -> Column:
    """Name of a position code; other numbers are named as unknown, text stays."""
    code = F.when(F.trim(value).rlike(r"^\d+$"), F.trim(value).try_cast("bigint"))
    named = F.lit(None).cast("string")
    for k, name in POSITIONS.items():
        named = F.when(code == k, name).otherwise(named)
    return F.when(code.isNull(), collapse(value)).otherwise(F.coalesce(named, F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")"))))


def document_kind(raw: Column) -> Column:
    """struct(kind, known, raw) of a source's document type; unknown values are kept as they are."""
    text = F.lower(collapse(raw))
    kind = F.when(text.isin("presentation", "exhibit", "public testimony presentation"), "committee_presentation").when(text.contains("testimony"), "legacy_testimony").when(text.contains("letter"), "floor_letter").when(text.isin("witness registration", "agenda", "minutes"), "committee_document_other")
    return F.struct(F.coalesce(kind, F.lit("unknown")).alias("kind"), kind.isNotNull().alias("known"), raw.alias("raw"))


def page_document(family: Column, url: Column) -> Column:
    """struct of what a record shown on a page says about its document: kind and type by the section it stands in."""
    said = F.lower(family) == "publictestimony"
    return F.struct(
        F.when(said, "public_testimony").otherwise("committee_presentation").alias("document_kind"),
        F.when(said, "HTML testimony row").otherwise("Presentation").alias("raw_document_type"),
        F.lit("page_section").alias("classification_method"),
        F.lit("confirmed").alias("confidence"),
        F.when(~blank(url), url).alias("canonical_download_url"),
        F.lit("discovered").alias("download_status"),
    )


def display_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", collapse(first), collapse(last))


def committee_display(name: Column, kind: Column) -> Column:
    """The name, with its type before it unless the name already has it."""
    return F.when(blank(kind) | (F.instr(F.lower(name), F.lower(F.trim(kind))) > 0), name).otherwise(F.concat_ws(" ", F.trim(kind), name))


def meeting_id(code: Column, date: Column) -> Column:
    return F.concat(code, F.lit("|"), date)


def utc_stamp(value: Column) -> Column:
    """Time as UTC text with microseconds and Z; naive times are UTC, empty or unreadable ones null."""
    return F.date_format(F.try_to_timestamp(F.trim(value)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def source_date(value: Column) -> Column:
    """A source's date for comparison only: shifted to UTC if it has an offset; the text stays the record."""
    return F.try_to_timestamp(F.trim(value))


def url_findings(url: Column, hosts: list[str]) -> Column:
    """First finding about a download URL: missing, not_https, user_info, bad_port, unexpected_host; null if none."""
    text = F.trim(url)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(text, r"^[^:/]+://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:]*$", "")), r"\.$", "")
    port = F.regexp_extract(authority, r":([^:@]*)$", 1)
    return F.when(blank(url), "missing").when(scheme != "https", "not_https").when(authority.contains("@"), "user_info").when((port != "") & (port != "443"), "bad_port").when(~host.isin(hosts), "unexpected_host")


def nfkc(value: Column) -> Column:
    """Unicode compatibility form, composed; Spark has no function for it, so text beyond ASCII, whose form may differ, goes through Python in Arrow batches."""

    @F.pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else None)

    return F.coalesce(normalise(F.when(~value.rlike(r"^[\x00-\x7F]*$"), value)), value)


def safe_name(value: Column, limit: int = 180) -> Column:
    """File name for any system: illegal characters as _, no dots or spaces at the ends, reserved names marked, bounded length."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r'[\x00-\x1f<>:"/\\|?*]', "_"), r"^[ .]+|[ .]+$", "")
    text = F.when(text == "", "document").when(F.upper(F.substring_index(text, ".", 1)).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), text)).otherwise(text)
    return F.substring(text, 1, limit)


def archive_path(session: Column, bill: Column, kind: Column, ident: Column, name: Column, version: Column) -> Column:
    """session/bill/kind/id/name (NFKC), with __v0002 and so on before the extension from the second version on."""
    safe = safe_name(nfkc(name))
    stem, ext = F.regexp_replace(safe, r"\.[^.]*$", ""), F.regexp_extract(safe, r"(\.[^.]*)$", 1)
    versioned = F.when(version > 1, F.concat(stem, F.lit("__v"), F.lpad(version.cast("string"), 4, "0"), ext)).otherwise(safe)
    return F.concat_ws("/", session, bill, kind, ident, versioned)


def positive_id(value: Column) -> Column:
    return F.when(value.rlike(r"^[1-9]\d*$"), value.try_cast("bigint"))


def mime_type(value: Column) -> Column:
    return F.lower(F.trim(F.substring_index(value, ";", 1)))


def mime_extension(value: Column) -> Column:
    return _lookup(mime_type(value), EXTENSIONS)


def extension_fits(name: Column, mime: Column) -> Column:
    """Whether a name's extension is that of the type or an alias of it; null for an unknown type."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.coalesce(_lookup(ext, ALIASES), ext) == mime_extension(mime)


def backoff(attempt: Column, retry_after: Column, base: float = 2.0, cap: float = 300.0, longest: float = 3600.0) -> Column:
    """Seconds to wait: exponential up to a cap, or what the server asked for (bounded) if that is longer."""
    return F.greatest(F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1)), F.least(F.lit(longest), F.coalesce(retry_after.cast("double"), F.lit(0.0))))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date against now."""
    text = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""), r"\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("double")).otherwise(F.greatest(F.lit(0.0), (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double")))


def total_size(status: Column, content_range: Column, content_length: Column) -> Column:
    """Size of a remote file: the total of Content-Range unless *, else Content-Length of a whole answer."""
    total = F.regexp_extract(F.coalesce(content_range, F.lit("")), r"^bytes\s+[^/]*/(\d+)$", 1)
    length = F.when((status != 206) & content_length.rlike(r"^\d+$"), content_length.try_cast("bigint"))
    return F.when(total != "", total.try_cast("bigint")).otherwise(length)


def sponsor_bucket(level: Column, filed: Column) -> Column:
    return F.when(~blank(filed), "filing_notice").when(fold_ascii(level) == "chief", "chief").when(fold_ascii(level) == "regular", "regular").otherwise("unmapped")
