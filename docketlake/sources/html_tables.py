"""Record tables in rendered pages: extraction and outcome of each page."""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import let

C = F.col
#: Download route of a record: its family and number.
ROUTE = r"(?i)/downloads/([A-Za-z]+)/([1-9]\d*)"
EMPTY_MARKER = "no items to display"
_LAST_WORD = EMPTY_MARKER.split()[-1]
SECTION = "testimony"


class _Tables(HTMLParser):
    """Collects header cells, body rows with their links, all links, headings and text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.header, self.rows, self.links, self.text, self.sections = [], [], [], [], []
        self.row, self.cell, self.kind, self.in_row_links, self.heading = None, None, "", [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.header = []
        elif tag == "tr":
            self.row, self.kind, self.in_row_links = [], "", []
        elif tag in ("td", "th"):
            self.cell, self.kind = [], tag
        elif tag == "a":
            href = dict(attrs).get("href") or ""
            self.links.append(href)
            self.in_row_links.append(href)
        elif tag in ("h1", "h2", "h3", "h4", "caption"):
            self.heading = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.kind == "th":
                self.header = [c.lower() for c in self.row]
            elif "title" in self.header and self.in_row_links:
                self.rows.append({"cells": dict(zip(self.header, self.row, strict=False)), "links": list(dict.fromkeys(self.in_row_links))})
            self.row = None
        elif tag in ("h1", "h2", "h3", "h4", "caption") and self.heading is not None:
            self.sections.append(" ".join("".join(self.heading).split()).lower())
            self.heading = None

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.cell is not None:
            self.cell.append(data)
        if self.heading is not None:
            self.heading.append(data)


#: Plain markup: text and tags without special content, whose attributes are quoted and hold neither markup nor references. It is cut at its tags by one expression; all else goes through HTMLParser.
_NAMES = "table|thead|tbody|tfoot|tr|td|th|a|h[1-6]|caption|p|div|span|ul|ol|li|b|i|em|strong|br|html|head|body"
_QUOTED = r"""(?:'[^'<>&\0]*'|"[^"<>&\0]*")"""
_TAG = rf"""(?:/((?i:{_NAMES}))|((?i:{_NAMES}))((?:[ \t\n]+[A-Za-z][A-Za-z-]*={_QUOTED})*+))[ \t\n]*"""
PLAIN, TAG, CUT = re.compile(rf"(?:<{_TAG}>|[^<\0]++)*+"), re.compile(_TAG), re.compile("<([^>]*)>")
ATTRIBUTE, _HREF = re.compile(rf"([A-Za-z][A-Za-z-]*)=({_QUOTED})"), re.compile(_QUOTED)
#: What _Tables does at a tag; all other tags of plain markup do nothing.
_TABLE, _TR, _CELL, _LINK, _HEADING, _CELL_END, _TR_END, _HEADING_END = range(1, 9)
_HEADINGS = ("h1", "h2", "h3", "h4", "caption")
_DOES = {"table": _TABLE, "tr": _TR, "td": _CELL, "th": _CELL, "a": _LINK, "/td": _CELL_END, "/th": _CELL_END, "/tr": _TR_END} | {h: _HEADING for h in _HEADINGS} | {f"/{h}": _HEADING_END for h in _HEADINGS}
#: Usual spellings of tags without attributes.
_USUAL = {slash + n: (_DOES.get(slash + n, 0), n) for n in re.sub(r"h\[1-6\]", "h1|h2|h3|h4|h5|h6", _NAMES).split("|") for slash in ("", "/")}


class Read(NamedTuple):
    """What _Tables collects of a page."""

    rows: list[dict]
    links: list[str]
    sections: list[str]
    text: list[str]


def _plain(source: str) -> Read | None:
    """The tables of plain markup, as _Tables reads them; None if the markup is not plain."""
    parts = CUT.split(source)
    if "<" in parts[-1] or "\0" in source:
        return None
    if "&" in source:
        parts[::2] = [_unescape(x) if "&" in x else x for x in parts[::2]]
    rows, links, sections = [], [], []
    header, row, cell, kind, row_links, heading, titled = [], None, None, "", [], None, False
    for tag, data in zip(parts[1::2], parts[2::2], strict=True):
        known = _USUAL.get(tag)
        if known is not None:
            does, name = known
            attributes = None
        elif tag.startswith("a href=") and _HREF.fullmatch(tag, 7):
            does, attributes = _LINK, None
            href = tag[8:-1]
        else:
            m = TAG.fullmatch(tag)
            if m is None:
                return None
            end, name, attributes = m.groups()
            name = (name or end).lower()
            does = _DOES.get("/" + name if end else name, 0)
            href = dict((k.lower(), v[1:-1]) for k, v in ATTRIBUTE.findall(attributes)).get("href", "") if attributes else ""
        if does == _CELL:
            cell, kind = data, name
            if heading is not None and data:
                heading += data
            continue
        if does == _CELL_END:
            if cell is not None and row is not None:
                row.append(" ".join(cell.split()))
                cell = None
        elif does == _LINK:
            if known is not None:
                href = ""
            links.append(href)
            row_links.append(href)
        elif does == _TR:
            row, kind, row_links = [], "", []
        elif does == _TR_END:
            if row is not None:
                if kind == "th":
                    header = [c.lower() for c in row]
                    titled = "title" in header
                elif titled and row_links:
                    rows.append({"cells": dict(zip(header, row)), "links": list(dict.fromkeys(row_links))})  # noqa: B905
                row = None
        elif does == _TABLE:
            header, titled = [], False
        elif does == _HEADING:
            heading = ""
        elif does == _HEADING_END and heading is not None:
            sections.append(" ".join(heading.split()).lower())
            heading = None
        if data:
            if cell is not None:
                cell += data
            if heading is not None:
                heading += data
    return Read(rows, links, sections, parts[::2])


def _unescape(text: str) -> str:
    return text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(text)


def read_tables(source: str) -> tuple[Read, str | None]:
    """The tables of a page, and what is wrong with its markup."""
    plain = _plain(source)
    if plain is not None:
        return plain, None
    p, error = _Tables(), None
    try:
        p.feed(source)
        p.close()
    except (ValueError, AssertionError) as e:  # what html.parser raises on broken markup
        error = str(e)
    return Read(p.rows, p.links, p.sections, p.text), error


def _says_empty(text: list[str]) -> bool:
    said = "".join(text).lower()
    return _LAST_WORD in said and EMPTY_MARKER in " ".join(said.split())


#: Characters of pages that are parsed at a time.
PARSED = 4_000_000
_ROW = pa.struct([("cells", pa.map_(pa.string(), pa.string())), ("links", pa.list_(pa.string()))])
_PARSED = pa.schema([("page_id", pa.int64()), ("rows", pa.list_(_ROW)), ("links", pa.list_(pa.string())), ("sections", pa.list_(pa.string())), ("says_empty", pa.bool_()), ("error", pa.string())])


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, rows, links, sections, says_empty, error) of (page_id, html). The only Python step; all rules are expressions below. What is
    parsed is passed on after every PARSED characters, so memory is bound by bytes and not by rows."""
    schema = "page_id long, rows array<struct<cells:map<string,string>,links:array<string>>>, links array<string>, sections array<string>, says_empty boolean, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = _Flat(), 0
            sources = (x.as_py() for x in batch.column(1)) if batch.column(1).nbytes > PARSED else batch.column(1).to_pylist()
            for page_id, source in zip(batch.column(0).to_pylist(), sources, strict=True):
                source = source or ""
                held += len(source)
                if held > PARSED:
                    yield out.batch()
                    out, held = _Flat(), len(source)
                out.add(page_id, *read_tables(source))
            yield out.batch()

    return pages.select(C("page_id").cast("long"), "html").mapInArrow(run, schema)


def _lists(sizes: list[int], inner: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(itertools.accumulate(sizes, initial=0), pa.int32()), inner)


def _strings(sizes: list[int], values: list[str]) -> pa.Array:
    return _lists(sizes, pa.array(values, pa.string()))


class _Flat:
    """Pages as flat lists, from which Arrow columns are built: no nested object outlives its page, so the collector of cycles has nothing to walk through."""

    def __init__(self) -> None:
        self.ids, self.rows, self.links, self.sections, self.empty, self.errors = [], [], [], [], [], []
        self.cells, self.keys, self.values, self.row_links, self.row_hrefs, self.hrefs, self.names = [], [], [], [], [], [], []

    def add(self, page_id: int, p: Read, error: str | None) -> None:
        self.ids.append(page_id)
        self.rows.append(len(p.rows))
        for r in p.rows:
            cells, links = r["cells"], r["links"]
            self.cells.append(len(cells))
            self.keys.extend(cells)
            self.values.extend(cells.values())
            self.row_links.append(len(links))
            self.row_hrefs.extend(links)
        self.links.append(len(p.links))
        self.hrefs.extend(p.links)
        self.sections.append(len(p.sections))
        self.names.extend(p.sections)
        self.empty.append(_says_empty(p.text))
        self.errors.append(error)

    def batch(self) -> pa.RecordBatch:
        cells = pa.MapArray.from_arrays(pa.array(itertools.accumulate(self.cells, initial=0), pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        inner = pa.StructArray.from_arrays([cells, _strings(self.row_links, self.row_hrefs)], fields=list(_ROW))
        columns = [pa.array(self.ids, pa.int64()), _lists(self.rows, inner), _strings(self.links, self.hrefs), _strings(self.sections, self.names), pa.array(self.empty, pa.bool_()), pa.array(self.errors, pa.string())]
        return pa.record_batch(columns, names=_PARSED.names)


#: Columns of a record and their headers.
COLUMNS = {"title": "title", "submitter": "submitter", "on_behalf_of": "on behalf of", "position": "position", "organization": "city or organization", "meeting": "meeting", "committee": "committee"}


def check_pages(parsed: DataFrame, route: str = ROUTE) -> DataFrame:
    """(page_id, records, pages): the records of a page, sorted, each struct(family, source_id, COLUMNS, conflict), and the outcome of each of its rows in `parsed`, struct(outcome, n_rows).

    Equal records are one; records of one identity with different content are in conflict, and the least is kept. A page is parsed and shuffled once for both; rows of equal page_id count as one page.
    parser_anomalous on an error, a conflict or links without rows; checked_with_records with rows; checked_zero for a recognised section that says it is empty; otherwise parser_anomalous.
    """
    cell = lambda r, name: F.nullif(F.element_at(r["cells"], F.lit(name)), F.lit(""))
    number = lambda link: F.regexp_extract(link, route, 2).cast("bigint")
    routed = F.filter(F.transform("rows", lambda r: F.struct(F.element_at(F.filter(r["links"], lambda x: x.rlike(route)), 1).alias("link"), *[cell(r, h).alias(c) for c, h in COLUMNS.items()])), lambda r: r["link"].isNotNull())
    found = F.transform(routed, lambda r: F.struct(F.lower(F.regexp_extract(r["link"], route, 1)).alias("family"), number(r["link"]).alias("source_id"), F.struct(*[r[c].alias(c) for c in COLUMNS]).alias("said")))
    linked = F.array_distinct(F.transform(F.filter("links", lambda x: x.rlike(route)), number))
    empty = F.exists("sections", lambda s: s.contains(SECTION)) & C("says_empty")
    flat = parsed.select("page_id", found.alias("found"), F.struct(linked.alias("linked"), empty.alias("empty"), C("error").isNotNull().alias("error")).alias("page"))
    pages = flat.groupBy("page_id").agg(F.collect_list("found").alias("found"), F.collect_list("page").alias("pages"))
    same = lambda a, b: a["family"].eqNullSafe(b["family"]) & a["source_id"].eqNullSafe(b["source_id"])
    differs = lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))
    marked = lambda a: F.transform(a, lambda x, i: F.struct(x["family"].alias("family"), x["source_id"].alias("source_id"), *[x["said"][c].alias(c) for c in COLUMNS], (((i == 0) | ~same(x, F.get(a, i - 1)))).alias("first"), F.coalesce(same(x, F.get(a, i + 1)), F.lit(False)).alias("conflict")))
    kept = lambda a: F.transform(F.filter(marked(a), lambda x: x["first"]), lambda x: x.dropFields("first"))
    # sorted, so equal records are neighbours; each array is computed once, since a lambda that named a column's expression would compute it again for each element
    pages = pages.select("page_id", let(let(F.sort_array(F.flatten("found")), differs), kept).alias("records"), "pages")

    def outcome(known: Column) -> Column:
        bad = lambda p: p["error"] | known["conflict"] | (F.size(F.array_except(p["linked"], known["ids"])) > 0)
        named = lambda p: F.when(bad(p), "parser_anomalous").when(known["n_rows"] > 0, "checked_with_records").when(p["empty"], "checked_zero").otherwise("parser_anomalous")
        return F.transform("pages", lambda p: F.struct(named(p).alias("outcome"), known["n_rows"].alias("n_rows")))

    known = lambda r: F.struct(F.exists(r, lambda x: x["conflict"]).alias("conflict"), F.array_distinct(F.transform(r, lambda x: x["source_id"])).alias("ids"), F.size(r).cast("long").alias("n_rows"))
    return pages.select("page_id", "records", let(let(C("records"), known), outcome).alias("pages"))


def records_of(checked: DataFrame) -> DataFrame:
    """(page_id, family, source_id, title, submitter, on_behalf_of, position, organization, meeting, committee, conflict) of checked pages, a row a record."""
    return checked.select("page_id", F.explode("records").alias("r")).select("page_id", "r.*")


def outcomes_of(checked: DataFrame) -> DataFrame:
    """(page_id, outcome, n_rows) of checked pages, a row a page that was parsed."""
    return checked.select("page_id", F.explode("pages").alias("p")).select("page_id", "p.*")


def identities_of(checked: DataFrame, proof: list[str]) -> DataFrame:
    """(page_id, records, pages, outcome) of checked pages with the identity of each record alone, struct(family, source_id, conflict), a row a page_id. outcome: of rows of one page_id, the first that is in
    `proof`, or the first. For those that keep checked pages and want no text of theirs."""
    outcomes = F.transform("pages", lambda p: p["outcome"])
    first = F.coalesce(F.get(F.filter(outcomes, lambda o: o.isin(proof)), F.lit(0)), F.get(outcomes, F.lit(0)))
    return checked.select("page_id", F.transform("records", lambda r: F.struct(r["family"].alias("family"), r["source_id"].alias("source_id"), r["conflict"].alias("conflict"))).alias("records"), "pages", first.alias("outcome"))


def extract_rows(parsed: DataFrame, route: str = ROUTE) -> DataFrame:
    """The records of parsed pages; see check_pages and records_of."""
    return records_of(check_pages(parsed, route))


def classify_pages(parsed: DataFrame, route: str = ROUTE) -> DataFrame:
    """The outcomes of parsed pages; see check_pages and outcomes_of."""
    return outcomes_of(check_pages(parsed, route))
