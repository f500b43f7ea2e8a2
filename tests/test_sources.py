"""Packages and payloads against real files, source contracts, routes and JSON."""

import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from docketlake.sources import payloads


def _package(names, method=zipfile.ZIP_DEFLATED, comment=b"", body=b"<x/>"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n in names:
            if isinstance(n, zipfile.ZipInfo):
                z.writestr(n, b"target")
            else:
                z.writestr(n, body)
        z.comment = comment
    return out.getvalue()


def test_files_of_every_verdict(spark, tmp_path):
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    good = _package(["[Content_Types].xml", "word/document.xml"])
    broken = bytearray(_package(["a.txt"], zipfile.ZIP_STORED, body=b"hello world"))
    broken[broken.index(b"hello")] ^= 1
    many = _package([f"m{i}" for i in range(10_001)], zipfile.ZIP_STORED, body=b"")
    ole = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 50
    files = {
        "a.docx": (good, "docx", "valid"),
        "b.bin": (_package(["XL\\Workbook.xml"], comment=b"a comment PK\x01\x02"), "xlsx", "valid"),
        "c.bin": (_package(["xl/workbook.xml", "xl/vbaProject.bin"]), "xlsm", "valid"),
        "d.bin": (_package(["ppt/presentation.xml", "ünï/ç.txt"]), "pptx", "valid"),
        "e.zip": (_package(["x/y.txt"]), "zip", "valid"),
        "f.zip": (good[:-10], "zip", "unreadable_package"),
        "g.zip": (_package(["../up.txt"]), "zip", "unsafe_path"),
        "h.zip": (_package(["ok", "C:/win.txt"]), "zip", "unsafe_path"),
        "i.zip": (_package([link]), "zip", "unsafe_path"),
        "j.zip": (_package(["zeros"], body=b"\0" * 1_000_000), "zip", "compression_ratio"),
        "k.zip": (many, "zip", "too_many_entries"),
        "l.zip": (bytes(broken), "zip", "corrupt_member"),
        "m.pdf": (b"%PDF-1.4 text %%EOF\n", "pdf", "valid"),
        "n.pdf": (b"%PDF-1.4 %%EOF" + b" " * 9000, "pdf", "pdf_without_end"),
        "o.xls": (ole, "xls", "valid"),
        "p": (ole, "doc", "valid"),
        "q.pdf": (b"\xef\xbb\xbf \n<BODY>sign in</body>", "html", "html"),
        "r.txt": (b"plain text", "txt", "no_signature"),
        "s.pdf": (b"", None, "unavailable"),  # Spark's reader leaves empty files out
        "t.pdf": (b"\x89PNG\r\n\x1a\n...", "png", "expected_pdf"),
        "u.pdf": (b"%PDF-1.4 %%EOF", "pdf", "length_mismatch"),
        "v.pdf": (b"%PDF-1.4 %%EOF.", "pdf", "hash_mismatch"),
        "w.pdf": (b"%PDF-1.4 %%EOF..", "pdf", "valid"),
        "x.rtf": (b"{\\rtf1 a}", "rtf", "valid"),
        "y.gif": (b"GIF88a", "gif", "no_signature"),
        "z.xml": (b"\xff\xfe<?xml version='1.0'?><a/>", "xml", "valid"),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / name).write_bytes(data)
    found = payloads.scan(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    told = {"p": "text/html; x=1", "w.pdf": "Image/PNG", "m.pdf": "application/octet-stream"}
    mime = F.create_map(*[F.lit(x) for kv in told.items() for x in kv])[F.col("name")]
    rows = found.select(F.col("name").alias("path"), "content", mime.alias("declared_mime"))
    expected = spark.createDataFrame(
        [("s.pdf", None, None, None), ("u.pdf", 3, None, None), ("t.pdf", None, "application/pdf", None), ("v.pdf", None, None, "00"), ("w.pdf", 16, "application/pdf", hashlib.sha256(files["w.pdf"][0]).hexdigest().upper())],
        "path string, expected_length long, expected_mime string, expected_sha256 string",
    )
    got = {r["path"]: (r["type"], r["verdict"], r["note"]) for r in payloads.validate_files(rows, expected).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[1:] for k, v in files.items()}
    assert got["w.pdf"][2] == "declared image/png, found application/pdf" and got["p"][2] == "declared text/html, found application/msword" and got["m.pdf"][2] is None
    unopened = {r["path"]: r["verdict"] for r in payloads.validate_files(rows, expected, unpack=False).collect()}
    assert unopened["l.zip"] == "valid" and unopened["g.zip"] == "unsafe_path"
    odd = spark.createDataFrame([("n", None), ("n", b"%PDF-%%EOF"), ("e.pdf", b"")], "path string, content binary")
    assert sorted(r["verdict"] for r in payloads.validate_files(odd, expected.limit(0)).collect()) == ["empty", "unavailable", "valid"]


def test_plain_markup_is_read_as_the_parser_reads_it():
    import random

    from docketlake.sources import html_tables as H

    draw = random.Random(3)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<TH>", "</th >", "<a href='/Downloads/X/1'>", '<A HREF="/downloads/y/22" class=\'q\'>', "</a>", "<h2>", "</h2>", "<caption>", "</caption>", "Title", "title", " a\n b ", "&amp;", "&lt;x", "&copy", "&#65;", "é", "<br>", "no items to display", " > ", "<a>"]
    odd = ["<!-- <tr> -->", "<a href=x>", "<script><td></script>", "< td>", "<td", "<a href='?a=1&amp;b'>", "<![CDATA[x]]>"]
    plain = 0
    for k in range(3000):
        source = "".join(draw.choice(bits if k % 3 else bits + odd) for _ in range(draw.randint(0, 30)))
        plain += bool(H.PLAIN.fullmatch(source))
        want = H._Tables()
        want.feed(source)
        want.close()
        got, error = H.read_tables(source)
        assert error is None and (got.rows, got.links, got.sections, "".join(got.text)) == (want.rows, want.links, want.sections, "".join(want.text)), source
    assert 2000 < plain < 3000


def test_pages_are_checked_once_with_conflicts_copies_and_repeated_ids(spark):
    from docketlake.sources import html_tables as H

    row = "<tr><td><a href='/Downloads/X/{}'>{}</a></td></tr>"
    page = lambda *rows: "<h2>Testimony</h2><table><tr><th>Title</th></tr>" + "".join(row.format(*r) for r in rows) + "</table>"
    pages = [(1, page((1, "a"), (1, "a"), (2, "b"))), (2, page((1, "a"), (1, "b"), (3, ""))), (3, page((1, "a"))), (3, page((1, "c"), (2, "d"))), (4, "<h2>Testimony</h2>No items to display"), (5, "<a href='/Downloads/X/9'>x</a>"), (6, None)]
    checked = H.check_pages(H.parse_pages(spark.createDataFrame(pages, "page_id long, html string")))
    outcomes = sorted(tuple(r) for r in H.outcomes_of(checked).collect())
    bad = "parser_anomalous"
    assert outcomes == [(1, "checked_with_records", 2), (2, bad, 2), (3, bad, 2), (3, bad, 2), (4, "checked_zero", 0), (5, bad, 0), (6, bad, 0)]
    records = sorted((r["page_id"], r["source_id"], r["title"], r["conflict"]) for r in H.records_of(checked).collect())
    assert records == [(1, 1, "a", False), (1, 2, "b", False), (2, 1, "a", True), (2, 3, None, False), (3, 1, "a", True), (3, 2, "d", False)]
