"""ZIP packages: their central directory read by binary expressions, what they hold, and whether they may be opened."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import let

C = F.col
#: Bounds of a package that may be opened, and the member that each Office type must have.
MOST_ENTRIES, MOST_EXPANDED, MOST_RATIO = 10_000, 512 * 1024 * 1024, 250
MEMBERS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "xlsm": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
MACROS = "xl/vbaproject.bin"
#: Bytes of the end record without its comment, and the longest comment.
_END, _COMMENT = 22, 65_535
_ENTRY = "struct<name: string, size: bigint, packed: bigint, symlink: boolean>"


def number(data: Column | str, at: Column, size: int) -> Column:
    """Little-endian number of `size` bytes from the zero-based place `at` of a binary."""
    digits = [F.lpad(F.hex(F.substring(data, at + k + 1, F.lit(1))), 2, "0") for k in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).try_cast("bigint")


def directory(content: Column) -> Column:
    """struct(entries, offset, size, readable) of the end record, which is searched from the end of the file; not readable without a whole one."""
    tail = F.decode(F.substring(content, F.greatest(F.length(content) - _END - _COMMENT, F.lit(0)) + 1, F.lit(_END + _COMMENT)), "ISO-8859-1")

    def read(after: Column) -> Column:
        entries, size, offset, comment = (number(after, F.lit(k), n) for k, n in ((6, 2), (8, 4), (12, 4), (16, 2)))
        whole = (F.length(after) >= _END - 4) & (comment == F.length(after) - _END + 4) & (offset + size <= F.length(content) - F.length(after) - 4)
        return F.struct(entries.alias("entries"), offset.alias("offset"), size.alias("size"), F.coalesce(whole, F.lit(False)).alias("readable"))

    # what follows the last signature
    return let(tail, lambda t: let(F.when(t.contains("PK\x05\x06"), F.encode(F.substring_index(t, "PK\x05\x06", -1), "ISO-8859-1")), read))


def members(central: Column, entries: Column) -> Column:
    """array of struct(name, size, packed, symlink) of a central directory; null where its records do not follow each other to its end."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_ENTRY}>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        field = lambda k, n: number(central, at + k, n)
        name = F.decode(F.substring(central, at + 47, field(28, 2).cast("int")), "UTF-8")
        right = (at >= 0) & (F.hex(F.substring(central, at + 1, F.lit(4))) == "504B0102") & (at + 46 + field(28, 2) <= F.length(central))
        mode = F.floor(field(38, 4) / 4096 / 65536).cast("bigint")  # the kind of file in a Unix mode
        entry = F.struct(F.translate(name, "\\", "/").alias("name"), field(24, 4).alias("size"), field(20, 4).alias("packed"), (mode == 10).alias("symlink"))
        after = at + 46 + field(28, 2) + field(30, 2) + field(32, 2)
        return F.struct(F.when(right, after).otherwise(F.lit(-1).cast("bigint")).alias("at"), F.when(right, F.concat(state["found"], F.array(entry.cast(_ENTRY)))).otherwise(state["found"]).alias("found"))

    walked = F.aggregate(F.when(entries > 0, F.sequence(F.lit(1).cast("bigint"), entries)).otherwise(F.array().cast("array<bigint>")), start, step)
    return F.when(walked["at"] == F.length(central), walked["found"])


def package_problem(entries: Column, found: Column) -> Column:
    """First problem of a package by its directory: too many entries, an unsafe path, then by the first entry that exceeds a bound; null if it may be opened."""
    def reason(state: Column, e: Column) -> Column:
        total = state["total"] + e["size"]
        parts = F.split(e["name"], "/")
        unsafe = e["name"].startswith("/") | e["name"].rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | e["symlink"]
        now = F.when(unsafe, "unsafe_path").when(total > MOST_EXPANDED, "expanded_size").when((e["size"] > 0) & (e["size"] > MOST_RATIO * F.greatest(e["packed"], F.lit(1))), "compression_ratio")
        return F.struct(total.alias("total"), F.coalesce(state["problem"], now).alias("problem"))

    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("string").alias("problem"))
    return F.when(entries > MOST_ENTRIES, "too_many_entries").when(found.isNull(), "unreadable_package").otherwise(F.aggregate(found, start, reason)["problem"])


def inspect(files: DataFrame, content: str = "content") -> DataFrame:
    """files with package: struct(type, problem, members), null for what is no ZIP file.

    type is docx, xlsx, xlsm or pptx by the members, else zip; a package with a problem is a zip. Only the end record and the central directory are
    read, by built-in functions; directories of more than MOST_ENTRIES entries are not walked. Names compare without case.
    """
    data = C(content)

    def described(found: Column, problem: Column) -> Column:
        names = F.transform(found, lambda e: F.lower(e["name"]))
        has = lambda held, member: F.array_contains(held, member)
        kind = lambda held: F.when(problem.isNotNull(), "zip").when(has(held, MEMBERS["docx"]), "docx").when(has(held, MEMBERS["xlsx"]) & has(held, MACROS), "xlsm").when(has(held, MEMBERS["xlsx"]), "xlsx").when(has(held, MEMBERS["pptx"]), "pptx").otherwise("zip")
        return let(names, lambda held: F.struct(kind(held).alias("type"), problem.alias("problem"), held.alias("members")))

    def package(end: Column) -> Column:
        central = F.when(end["readable"] & (end["entries"] <= MOST_ENTRIES), F.substring(data, end["offset"].cast("int") + 1, end["size"].cast("int")))
        problem = lambda found: F.when(~end["readable"], "unreadable_package").otherwise(package_problem(end["entries"], found))
        return let(central, lambda c: let(members(c, end["entries"]), lambda found: let(problem(found), lambda p: described(found, p))))

    return files.withColumn("package", F.when(F.hex(F.substring(data, 1, 4)) == "504B0304", let(directory(data), package)))


def broken_members(packages: DataFrame) -> DataFrame:
    """(path, member) of packages (path, content) whose members do not unpack to their checksums: the first one of each.

    To be called on packages without a problem, whose expanded size is bounded; members are unpacked in pieces. Spark has no function that inflates, so
    this goes through Python, a file at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        bad = archive.testzip()
                except (zipfile.BadZipFile, zipfile.LargeZipFile, RuntimeError, NotImplementedError, OSError, EOFError, zlib.error, ValueError):
                    bad = ""
                if bad is not None:
                    out.append((path, bad))
            yield pd.DataFrame(out, columns=["path", "member"])

    return packages.select("path", "content").mapInPandas(run, "path string, member string")
