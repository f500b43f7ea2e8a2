"""Main text of web pages: boilerplate elements and templates of a site are removed."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.base import checkpoint, map_batches

#: A "<" outside quotes ends a tag that was never closed, so a search never looks past the next one; a quote that is never closed is a plain character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>]++)*+(?=>)|[^<>]*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: Elements of HTML by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption tr ul ol table tbody thead dl b i em strong a span code q cite sub sup u s small mark br".split())
BOILERPLATE = frozenset("script style noscript template iframe head title nav footer aside form button select textarea object svg canvas menu dialog".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsored promo banner cookie cookies consent notice notices alert comment comments disqus replies sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social newsletter subscribe related popup modal widget pagination pager masthead".split())
#: Words that are marks only as a whole class, id or role, the last one only outside an article; words that deny a mark they are joined with.
WHOLE_MARKS, DENIALS = frozenset("topbar toolbar search searchbox searchform login signin responses respond header".split()), frozenset("has no non not with without free".split())
#: Beginnings of joined marks (commentlist, sidebarleft), and a word of text that begins like one.
STEMS, NO_STEMS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "navbar", "newsletter", "sidebar", "sponsor"), ("commentar",)
#: Share of links in the text, and links at least, of a block outside an article that only leads elsewhere.
LINKED, LEAST_LINKS = 0.6, 3
CLOSED_BY = {"li": frozenset(["li"]), "p": BLOCKS, "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
HOLDS = {"li": frozenset(["ul", "ol", "menu"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "p": frozenset(), "option": frozenset()}


CLOSING = frozenset().union(*CLOSED_BY.values())
_RAW_END = {tag: re.compile(rf"(?i)</{tag}(?=[\s/>])") for tag in RAW}
_FRAME = frozenset(["#page", "html", "body", "article", "main", "head"])


def _named(word: str) -> bool:
    return word in MARKS or word.startswith(STEMS) and not word.startswith(NO_STEMS)


def _mark(attributes: str) -> str:
    """How class, id or role name an element as boilerplate: `whole` by a name of its own, `header` by just that, `joined` by a part of a name, or not at all."""
    found = ""
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = re.split(r"[_-]+", name)
            if name == "header":
                found = found or "header"
            elif name in WHOLE_MARKS or len(parts) == 1 and _named(name):
                return "whole"
            elif not DENIALS.intersection(parts) and any(map(_named, parts)):
                found = "joined"
    return found


class Page:
    """Elements of a page in order of their start tags: tags, parents, and each one's parts (texts and numbers of children)."""

    def __init__(self, source: str):
        self.tags, self.marks, self.parents, self.parts = ["#page"], [""], [-1], [[]]
        stack, at, open_tags = [0], 0, Counter()
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self.parts[stack[-1]].append(source[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if open_tags[tag]:
                    while self.tags[stack[-1]] != tag:
                        open_tags[self.tags[stack.pop()]] -= 1
                    open_tags[self.tags[stack.pop()]] -= 1
                continue
            if tag in CLOSING:
                self._close_implied(stack, tag, open_tags)
            self.tags.append(tag)
            self.marks.append(m[3])
            self.parents.append(stack[-1])
            self.parts.append([])
            self.parts[stack[-1]].append(len(self.tags) - 1)
            if tag in VOID or m[3].endswith("/"):
                continue
            stack.append(len(self.tags) - 1)
            open_tags[tag] += 1
            if tag in RAW:  # up to its own end tag, all is text
                end = _RAW_END[tag].search(source, at)
                stop = end.start() if end else len(source)
                if stop > at:
                    self.parts[-1].append(source[at:stop])
                at = stop
        if at < len(source):
            self.parts[stack[-1]].append(source[at:])
        self._measure()
        self._find_mains()

    def _close_implied(self, stack: list[int], tag: str, open_tags: Counter[str]) -> None:
        if not any(open_tags[t] for t, by in CLOSED_BY.items() if tag in by):
            return
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = self.tags[stack[depth]]
            if tag in CLOSED_BY.get(open_tag, ()):
                open_tags.subtract(self.tags[i] for i in stack[depth:])
                del stack[depth:]
                return
            if tag in HOLDS.get(open_tag, ()) or open_tag in BLOCKS and not (tag in HOLDS and open_tag not in HOLDS[tag]):
                return

    def _measure(self) -> None:
        """sizes and linked: characters of each element's text without white space and boilerplate tags, and those of them in links; links: how many; titled: whether a top heading, article or main stands in it."""
        n = len(self.tags)
        self.sizes, self.linked, self.links, self.titled, self.worded = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
        for i in range(n - 1, -1, -1):
            tag = self.tags[i]
            if tag in BOILERPLATE:
                continue
            for part in self.parts[i]:
                if isinstance(part, str):
                    self.sizes[i] += sum(map(len, part.split()))
                else:
                    self.sizes[i] += self.sizes[part]
                    self.linked[i] += self.linked[part]
                    self.links[i] += self.links[part]
                    self.titled[i] |= self.titled[part] or self.tags[part] in ("h1", "article", "main")
                    self.worded[i] |= self.worded[part] or self.tags[part] in ("p", "h1", "h2", "h3", "pre", "blockquote")
            if tag == "a":
                self.linked[i], self.links[i] = self.sizes[i], 1

    def _is_marked(self, i: int, mark: str) -> bool:
        """Whether a mark counts. An element that holds the larger part of the page's text is marked only by a whole name, and only if no
        top heading or article stands in it; a part of a name marks text of its own (a paragraph, say) only where it is mostly links."""
        most = 2 * self.sizes[i] > self.sizes[0]
        if mark == "whole":
            return not (most and (self.titled[i] or self.tags[i] in ("article", "main")))
        return mark == "joined" and (2 * self.linked[i] >= self.sizes[i] > 0 or not most and self.tags[i] not in CONTENT - {"ul", "ol", "table", "dl", "span", "small"})

    def _outermost(self, tag: str, fit: list[bool]) -> list[int]:
        found, inside = [], [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            inside[i] = inside[self.parents[i]]
            if self.tags[i] == tag and fit[i] and not inside[i]:
                found.append(i)
                inside[i] = True
        return found

    def _find_mains(self) -> None:
        """mains: the outermost article elements in main elements, all of them in no boilerplate; else of main elements and articles
        outside of these, those with more text; else articles, then mains, that only a mark of an element around them (a layout's name) speaks against; else the whole page."""
        marks = ["" if tag in _FRAME - {"article", "main"} else _mark(attributes) for tag, attributes in zip(self.tags, self.marks, strict=True)]
        self.marked = [self._is_marked(i, mark) for i, mark in enumerate(marks)]
        self.headers = [mark == "header" for mark in marks]
        by_tag, by_mark, in_main = [False], [False], [False]
        for i in range(1, len(self.tags)):
            up = self.parents[i]
            by_tag.append(by_tag[up] or self.tags[i] in BOILERPLATE)
            by_mark.append(by_mark[up] or self.marked[i])
            in_main.append(in_main[up] or self.tags[up] == "main" and not by_tag[up] and not by_mark[up])
        clean = [not t and not m for t, m in zip(by_tag, by_mark, strict=True)]
        near = [not t and not m for t, m in zip(by_tag, self.marked, strict=True)]
        mains, articles = self._outermost("main", clean), self._outermost("article", clean)
        size = lambda found: sum(self.sizes[i] for i in found)
        if size(mains):
            inner = self._outermost("article", [c and m for c, m in zip(clean, in_main, strict=True)])
            self.mains = inner if size(inner) else mains if size(mains) >= size(articles) else articles
        else:
            self.mains = articles or mains or self._outermost("article", near) or self._outermost("main", near) or [0]

    def hashes(self) -> list[int]:
        """Hash of each element's subtree: its tag, texts and children in order."""
        out = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            key = [self.tags[i], *(" ".join(p.split()) if isinstance(p, str) else str(out[p]) for p in self.parts[i])]
            out[i] = xxhash.xxh3_64_intdigest("\x1f".join(key).encode("utf-8", "surrogatepass")) - (1 << 63)
        return out

    def removable(self) -> list[int]:
        """Elements that a template may consist of: all but the page's frame, and within an article none that is text of its own."""
        mains, protected = set(self.mains), [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            protected[i] = i in mains or protected[self.parents[i]]
        return [i for i, tag in enumerate(self.tags) if tag not in _FRAME and not (protected[i] and tag in CONTENT) and self.parts[i]]

    def _leads_elsewhere(self, i: int) -> bool:
        """Headers and blocks of links, which count on pages without an article only."""
        if self.tags[i] == "header" or self.headers[i] and 2 * self.sizes[i] <= self.sizes[0]:
            return True
        return self.tags[i] in ("ul", "ol", "div", "section", "table") and self.links[i] >= LEAST_LINKS and not self.worded[i] and self.linked[i] >= LINKED * self.sizes[i]

    def text(self, templates: frozenset[int]) -> str:
        gone: set[int] = set()
        if templates:
            hashes = self.hashes()
            gone = {i for i in self.removable() if hashes[i] in templates}
        mains = set(self.mains)
        blocks: list[list[str]] = [[]]
        work: list[tuple[int, int]] = [(m, 0) for m in reversed(self.mains)]  # an explicit stack: pages may nest deeply
        in_main = mains != {0}
        while work:
            i, k = work.pop()
            tag = self.tags[i]
            if k == 0:
                if i in gone or i not in mains and (tag in BOILERPLATE or self.marked[i] or not in_main and self._leads_elsewhere(i)):
                    continue
                if tag == "br":
                    blocks[-1].append(" ")
            if tag in BLOCKS and (k == 0 or k == len(self.parts[i])):
                blocks.append([])
            while k < len(self.parts[i]):
                part = self.parts[i][k]
                k += 1
                if isinstance(part, str):
                    blocks[-1].append(part)
                else:
                    work += [(i, k), (part, 0)]
                    break
            else:
                if tag in BLOCKS:
                    blocks.append([])
        lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def site_templates(pages: DataFrame, min_pages: int, share: float) -> DataFrame:
    """(host, pages, templates): hashes of element subtrees that stand on at least `min_pages` pages and `share` of a host's pages.

    A page with n elements has at most n of them, so a host has at most n/share: the arrays stay small
    however many pages a host has. Counts are summed per batch before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, int]] = Counter()
            for host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(source)
                hashes = page.hashes()
                found.update({(host, hashes[i]) for i in page.removable()})
                found[host, 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["host", "subtree", "n"])

    counts = checkpoint(map_batches(pages.select("host", "html").where("host is not null and html is not null"), count, "host string, subtree long, n long").groupBy("host", "subtree").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages))
    totals = counts.where("subtree = 0").select("host", F.col("n").alias("pages"))
    often = counts.where("subtree <> 0").join(totals, "host").where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host", "pages").agg(F.collect_list("subtree").alias("templates"))


def with_templates(source: DataFrame, templates: DataFrame, most_broadcast: int, pages_a_key: int) -> DataFrame:
    """Pages beside the templates of their hosts.

    Up to `most_broadcast` template hashes are broadcast, and pages stay where they are. More are joined by
    host, and a host of more than `pages_a_key` pages (more where the table is so large that there would
    be over 100,000 such hosts) is dealt over as many keys as it needs, to each of which its few templates go.
    """
    size = templates.agg(F.sum(F.size("templates")), F.sum("pages")).first()
    if (size[0] or 0) <= most_broadcast:
        return source.join(F.broadcast(templates.drop("pages")), "host", "left")
    a_key = max(pages_a_key, (size[1] or 0) // 100_000)
    hot = templates.select("host", F.ceil(F.col("pages") / a_key).cast("int").alias("keys")).where("keys > 1")
    dealt = source.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("keys", F.lit(1))).cast("int"))
    spread = templates.select("host", "templates", F.explode(F.sequence(F.lit(0), F.ceil(F.col("pages") / a_key).cast("int") - 1)).alias("salt"))
    return dealt.join(spread.hint("merge"), ["host", "salt"], "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 10, share: float = 0.5, most_broadcast: int = 1_000_000, pages_a_key: int = 10_000) -> DataFrame:
    """(page_id, url, text): the main text of every page, one row per input row.

    Text is that of the article elements in main, else of main or of articles outside it, whichever has more text, else of
    the whole page, without elements that are boilerplate by their tag or by the name that class, id or role give them, and without
    subtrees that recur on at least `share` (and `min_pages`) of the pages of the host. A part of a joined name (`related-posts`) counts only for an element that holds less
    than half of the page's text and is no paragraph or the like, unless it is mostly links; with `has`, `no`, `free` and the like beside it, it does not count. On pages without article and main, headers and blocks that are
    mostly links go as well. Paragraphs, headings and the like inside an article are never taken for a template: a site may publish an article many times.
    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined by a line break.

    Null and empty html gives an empty text; pages whose url has no host have no templates; a null id or url
    stays null. Rows that repeat count as pages of their own and give their text each. A page is read in time that grows with its
    length, also where tags are left open. Other columns are not read. An empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.when(host != "", host).alias("host"))
    templates = checkpoint(site_templates(source, min_pages, share))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h).text(frozenset(t or ())) if h else "" for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return map_batches(with_templates(source, templates, most_broadcast, pages_a_key).select("page_id", "url", "html", "templates"), extract, "page_id long, url string, text string")
