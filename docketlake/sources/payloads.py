"""Payload files: type by signature, ordered validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.records import EXTENSIONS, mime_type
from docketlake.sources import packages

C = F.col
#: Leading bytes of file types.
SIGNATURES = (("pdf", "255044462D"), ("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "47494638"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("bmp", "424D"), ("rtf", "7B5C727466"), ("ole", "D0CF11E0A1B11AE1"), ("zip", "504B0304"), ("xml", "3C3F786D6C"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of every file under a path; unread content is pruned by Spark, and files without content are left out by its reader."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def signature(content: Column) -> Column:
    """Type by leading bytes; HTML by its first tag within the first kilobyte; null for none."""
    head = F.lower(F.trim(F.substring(content, 1, 1024).cast("string")))
    out = F.when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
    for name, hex_ in SIGNATURES:
        out = out.when(F.hex(F.substring(content, 1, len(hex_) // 2)) == hex_, name)
    riff = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    return out.when(riff, "webp")


def detect_types(files: DataFrame) -> DataFrame:
    """Adds type and confidence to (path, content, declared_mime): strong by bytes, else declared, else filename, else none."""
    strong = signature(C("content"))
    declared = F.element_at(F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k, v[1:])]), mime_type(C("declared_mime")))
    ext = F.nullif(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)), F.lit(""))
    return files.withColumn("type", F.coalesce(strong, declared, ext)).withColumn("confidence", F.when(strong.isNotNull(), "strong").when(declared.isNotNull(), "declared").when(ext.isNotNull(), "filename").otherwise("none"))


def validate_payloads(files: DataFrame, expectations: DataFrame) -> DataFrame:
    """(path, verdict) of files (path, content) against expectations (path, expected_length, expected_type, expected_sha256): the first failure wins."""
    kind = signature(C("content"))
    tail = F.expr("substring(content, greatest(length(content) - 8191, 1), 8192)")
    verdict = (
        F.when(C("expected_length").isNotNull() & (C("expected_length") != F.length("content")), "length_mismatch")
        .when(F.length("content") == 0, "empty")
        .when(kind == "html", "html")
        .when(kind.isNull(), "no_signature")
        .when((C("expected_type") == "pdf") & (kind != "pdf"), "expected_pdf")
        .when((kind == "pdf") & ~F.contains(tail, F.lit("%%EOF").cast("binary")), "pdf_without_end")
        .when(C("expected_sha256").isNotNull() & (F.sha2("content", 256) != C("expected_sha256")), "hash_mismatch")
        .otherwise("valid")
    )
    return files.join(expectations, "path", "left").select("path", verdict.alias("verdict"))


#: Types of files that are no plain signature: their MIME types, Office types that share the signature of a compound document, and types that say nothing.
MIMES = {
    "pdf": "application/pdf", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp", "rtf": "application/rtf", "html": "text/html", "xml": "application/xml", "zip": "application/zip",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsm": "application/vnd.ms-excel.sheet.macroenabled.12", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
COMPOUND, GENERIC = ["doc", "xls", "ppt"], ["", "application/octet-stream", "binary/octet-stream", "application/download", "application/x-download"]
#: What else names a type, in a header or as a file's extension.
OTHER_MIMES = {"text/rtf": "rtf", "text/plain": "txt", "text/csv": "csv", "text/tab-separated-values": "tsv", "application/xhtml+xml": "html", "text/xml": "xml"}
SUFFIXES = [*MIMES, "jpg", "jpe", "tif", "htm", "txt", "csv", "tsv"]


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def text_head(content: Column) -> Column:
    """The first kilobyte in lower case after a byte order mark, zero bytes and white space."""
    return F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "^[\u00ef\u00bb\u00bf\u00ff\u00fe\u0000 \\t\\r\\n]+", ""))


def typed_files(files: DataFrame) -> DataFrame:
    """files (path, content[, declared_mime, logical_name]) with type, confidence and package.

    The ladder: bytes (strong), where a ZIP file is the Office type that its members make it, and a compound document is doc, xls or ppt by the declared type, else by the name, else doc; then the
    declared type; then a known extension; else none. A null content has no type by bytes.
    """
    for c in ("declared_mime", "logical_name"):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast("string"))
    rows = packages.inspect(files)
    declared = F.element_at(_table({v: k for k, v in MIMES.items()} | OTHER_MIMES), mime_type(C("declared_mime")))
    suffix = F.lower(F.regexp_extract(F.coalesce("logical_name", "path"), r"\.([A-Za-z0-9]{1,5})$", 1))
    plain, head = signature(C("content")), text_head(C("content"))
    hint = F.when(declared.isin(COMPOUND), declared).when(suffix.isin(COMPOUND), suffix).otherwise("doc")
    gif = F.hex(F.substring("content", 1, 6)).isin("474946383761", "474946383961")
    strong = F.when(plain == "zip", C("package.type")).when(plain == "ole", hint).when(plain.isin("html", "xml"), None).when((plain == "gif") & ~gif, None).otherwise(plain)
    strong = F.coalesce(strong, F.when(head.rlike("^<(!doctype html|html|head|body|title)"), "html").when(head.startswith("<?xml"), "xml"))
    named = F.when(suffix.isin(SUFFIXES), suffix)
    confidence = F.when(strong.isNotNull(), "strong").when(declared.isNotNull(), "declared").when(named.isNotNull(), "filename").otherwise("none")
    return rows.withColumns({"type": F.coalesce(strong, declared, named), "confidence": confidence})


def validate_files(files: DataFrame, expectations: DataFrame, unpack: bool = True) -> DataFrame:
    """(path, type, confidence, verdict, note) of files against expectations (path, expected_length, expected_mime, expected_sha256); a file without any is judged by itself.

    The first failure is the verdict: length_mismatch, empty, html, no_signature, expected_pdf, pdf_without_end (no mark in the last 8 KiB), a package's problem
    (unreadable_package, too_many_entries, unsafe_path, expanded_size, compression_ratio), corrupt_member (if `unpack`), hash_mismatch; else valid, whose note tells a declared type that
    differs from the one found. Every row of a path that repeats is judged. A null content, or an expected file that is not there, is `unavailable`.
    """
    rows = typed_files(files).join(expectations, "path", "full_outer")
    corrupt = F.lit(False)
    if unpack:
        open_ = rows.where(C("package").isNotNull() & C("package.problem").isNull()).select("path", "content")
        rows = rows.join(packages.broken_members(open_).select("path", F.lit(True).alias("corrupt_")).distinct(), "path", "left")
        corrupt = C("corrupt_").isNotNull()
    size, declared = F.length("content"), F.coalesce(mime_type(C("declared_mime")), F.lit(""))
    tail = F.expr("substring(content, greatest(length(content) - 8191, 1), 8192)")
    verdict = (
        F.when(C("content").isNull(), "unavailable")
        .when(C("expected_length").isNotNull() & (C("expected_length") != size), "length_mismatch")
        .when(size == 0, "empty")
        .when(C("type") == "html", "html")
        .when(C("confidence") != "strong", "no_signature")
        .when((mime_type(C("expected_mime")) == MIMES["pdf"]) & (C("type") != "pdf"), "expected_pdf")
        .when((C("type") == "pdf") & ~F.contains(tail, F.lit("%%EOF").cast("binary")), "pdf_without_end")
        .when(C("package.problem").isNotNull(), C("package.problem"))
        .when(corrupt, "corrupt_member")
        .when(F.coalesce(C("expected_sha256"), F.lit("")) != "", F.when(F.sha2("content", 256) != F.lower(F.trim("expected_sha256")), "hash_mismatch").otherwise("valid"))
        .otherwise("valid")
    )
    found = F.element_at(_table(MIMES), C("type"))
    note = F.when((verdict == "valid") & ~declared.isin(GENERIC) & (declared != found), F.format_string("declared %s, found %s", declared, found))
    return rows.select("path", "type", "confidence", verdict.alias("verdict"), note.alias("note"))
