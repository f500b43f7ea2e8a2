"""Personal data: detection in plain and in disguised form, with spans in the source text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.base import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters of other scripts that look like Latin ones, and their Latin counterparts.
LOOKALIKES = dict(zip("АВЕКМНОРСТХІЅЈаеорсухіѕјԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "ABEKMHOPCTXISJaeopcyxisjdqwABEZHIKMNOPTYXoa", strict=True))
#: Spelled digits.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGIT_WORDS |= dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True))
DIGIT_WORDS |= dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True))
DIGIT_WORDS |= dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True))

#: More such letters, of Greek, Cyrillic, Armenian and Cherokee.
LOOKALIKES |= dict(zip("ικνρυѵһӏոսօցհքᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ikvpuvhlnuoghpABCDEGHJKLMPSTVWZ", strict=True))
#: Stops of other scripts, which stand for a dot between plain letters or digits.
STOPS = "。｡․﹒"
#: Named character references of what identifiers are made of.
REFERENCES = {"commat": "@", "period": ".", "plus": "+"}
#: Letters that stand for a digit within a number.
DIGIT_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1"}
#: Words for a dot, and words for an at-mark that mean nothing else in an address.
DOT_WORDS = ("dot", "point", "punto", "punkt")
AT_WORDS = ("arroba", "arobase")

_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + "|[0-9])"
_DOTS = "|".join(DOT_WORDS)
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[\s,-]+)?{_DIGIT}(?:[\s,-]+{_DIGIT}(?!\w)|[\s,-]+(?:{_DOTS})\b[\s,-]*{_DIGIT}(?!\w)){{3,}}")
_SPELLED_WORD = re.compile(rf"(?i)\s*\b(?:{_DOTS})\b\s*|\bplus\b\s*|[^\W\d_]+|,\s*|\s+|-")
_REFERENCE = re.compile(r"&(?:#(?:0{0,8}([0-9]{2,3})|[xX]0{0,8}([0-9A-Fa-f]{2}))|(" + "|".join(REFERENCES) + "));")
_STOP = re.compile(rf"(?<=[A-Za-z0-9])[{STOPS}](?=[A-Za-z0-9])")
_NUMBER_LIKE = re.compile(r"(?<!\w)[0-9](?:[ -]?[0-9OoIl]){8,18}(?!\w)")


def _dot(words: str) -> str:
    return rf"(?:\s{{0,4}}[\[({{<]\s{{0,4}}(?:{words}|\.)\s{{0,4}}[\])}}>]\s{{0,4}}|\s{{1,4}}(?:{words})\s{{1,4}})"


def _address(words: str) -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """Name, host, part for a dot and word for a dot, where these words stand for one."""
    dot = _dot(words)
    name = re.compile(rf"(?i)[a-z0-9_%+-]{{1,64}}(?:(?:\.|{dot})[a-z0-9_%+-]{{1,64}}){{0,8}}\Z")
    host = re.compile(rf"(?i)[a-z0-9-]{{1,63}}(?:(?:\.|{dot})[a-z0-9-]{{1,63}}){{1,8}}")
    return name, host, re.compile(rf"(?i){dot}"), re.compile(rf"(?i)\s(?:{words})\s")


_DOT = _dot("dot")
_AT_MARK = re.compile(rf"(?i)[\[({{<]\s{{0,4}}(?:at|@|({'|'.join(AT_WORDS)}))\s{{0,4}}[\])}}>]|(?<=\s)(?:at|({'|'.join(AT_WORDS)}))(?=\s)|@")
#: After "at", which sentences are full of, only "dot" is a dot; the other at-words go with all of them.
_ENGLISH, _ANY_TONGUE = _address("dot"), _address(_DOTS)
#: What the longest name before an at-mark takes, in characters.
_NAME_SIZE = 9 * 64 + 8 * 23
_SPACES = 4
_TOP = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z]{2,24}\Z")
_DISGUISED_IP = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])")
_DOT_PART = re.compile(rf"(?i){_DOT}")
_ODD = re.compile("[" + "".join(LOOKALIKES) + "！-～​-‍⁠­٠-٩\U0001d400-\U0001d7ff①-⑳⁰-⁹₀-₉]")
_SPOKEN = frozenset(w.encode("latin-1") for w in DIGIT_WORDS) | frozenset(b"%d" % d for d in range(10)) | frozenset(w.encode() for w in DOT_WORDS) | {b"plus"}
#: Bytes of Latin-1 that are no word characters become spaces.
_WORD_BYTES = bytes(b if re.match(r"\w", chr(b)) else 32 for b in range(256))
#: Letters that match i or s where case does not count, and all that Latin-1 lacks and U+0100 to U+024F do not cover.
_FOLDED = re.compile("[İıſɐ-\U0010ffff]")
_BRACKETED = re.compile(r"[\[({<]\s{0,4}(?:[aA][tT]|\.)")


def may_be_spelled(text: str) -> bool:
    """Whether spelled_digits() could change a text: a run of it has four of its words in a row, with no other word between."""
    if _FOLDED.search(text):
        return True
    words = text.lower().encode("latin-1", "replace").translate(_WORD_BYTES).split()
    return b"\1\1\1\1" in bytes(map(_SPOKEN.__contains__, words))


def may_be_addressed(text: str) -> bool:
    """Whether at_and_dot() could change a text: what it changes has an @, the word dot, an at-word, or a bracket before at or a dot."""
    if "@" in text:
        return True
    lower = text.lower()
    return "dot" in lower or "arroba" in lower or "aroba" in lower or _BRACKETED.search(text) is not None  # "aroba", as a long s is no s in lower case


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _is_octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns, leftmost and non-overlapping per kind, in order of start, then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # from each @ outwards: linear, where a search from every start is quadratic on long words
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_is_octet(p) for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


class Tape:
    """A text on its way through transducers: each character knows the source range that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = range(len(text))
        self.ends = range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges (ascending, disjoint); a replacement stands for the whole range."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for lo, hi, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:lo])
            starts += self.starts[at:lo]
            ends += self.ends[at:lo]
            text.append(new)
            if hi > lo:
                starts += [self.starts[lo]] * len(new)
                ends += [self.ends[hi - 1]] * len(new)
            at = hi
        self.text, self.starts, self.ends = "".join(text), starts, ends


def plain_letters(tape: Tape) -> None:
    """Homoglyphs, full-width and stylised forms become the plain character; invisible ones go."""
    edits = []
    for m in _ODD.finditer(tape.text):
        c = m[0]
        new = LOOKALIKES.get(c) or ("" if unicodedata.category(c) == "Cf" else unicodedata.normalize("NFKC", c))
        if new.isdecimal() and not new.isascii():
            new = "".join(str(unicodedata.decimal(x)) for x in new)
        edits.append((m.start(), m.end(), new))
    tape.rewrite(edits)


def references(tape: Tape) -> None:
    """Character references of printable ASCII, and the named ones of marks, become the character."""
    edits = []
    for m in _REFERENCE.finditer(tape.text):
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else 0
        if m[3] or 32 <= code < 127:
            edits.append((m.start(), m.end(), REFERENCES[m[3]] if m[3] else chr(code)))
    tape.rewrite(edits)


def stops(tape: Tape) -> None:
    """Stops of other scripts between plain letters or digits become dots."""
    tape.rewrite([(m.start(), m.end(), ".") for m in _STOP.finditer(tape.text)])


def lettered_digits(tape: Tape) -> None:
    """In numbers of nine digits or more, letters that touch a digit and look like one become it, where they are at most a fourth."""
    edits = []
    for run in _NUMBER_LIKE.finditer(tape.text):
        letters = [i for i, c in enumerate(run[0]) if c in DIGIT_LETTERS]
        if letters and 4 * len(letters) <= sum(c not in " -" for c in run[0]):
            touching = [i for i in letters if not {run[0][i - 1], run[0][i + 1 : i + 2]} <= {" ", "-", ""}]
            edits += [(run.start() + i, run.start() + i + 1, DIGIT_LETTERS[run[0][i]]) for i in touching]
    tape.rewrite(edits)


def spelled_digits(tape: Tape) -> None:
    """Runs of at least four digits of which some are spelled become digits, with single spaces, dots and plus.

    A run, or a part of it between commas, of four parts with dots between, each of three digits at most and not over 255,
    is an IP: its spelled digits are joined. Numerals are not, as they may be parts of their own.
    """
    text, edits = tape.text, []
    for run in _SPELLED.finditer(text):
        own = []
        for m in _SPELLED_WORD.finditer(text, run.start(), run.end()):
            word = m[0].strip().lower()
            new = "." if word in DOT_WORDS else "+" if word == "plus" else " " if word in ("", ",") else DIGIT_WORDS.get(word, m[0])
            own.append((m.start(), m.end(), new))
        if sum(new == "." for _, _, new in own) >= 3:
            own = _join_octets(text, run.start(), run.end(), own)
        edits += [e for e in own if text[e[0] : e[1]] != e[2]]
    tape.rewrite(edits)


def _join_octets(text: str, start: int, end: int, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits of a spelled run, without what they leave between the spelled digits of its IPs."""
    commas = [k for k, (lo, _, new) in enumerate(edits) if text[lo] == "," and new == " "]
    out = list(edits)
    for ks in ([], commas):
        for a, b in zip([-1, *ks], [*ks, len(edits)], strict=True):
            part, at = edits[a + 1 : b], edits[a][1] if a >= 0 else start
            said = []
            for lo, hi, new in part:
                said += [text[at:lo], new.strip(" -")]
                at = hi
            octets = "".join([*said, text[at : edits[b][0] if b < len(edits) else end]]).split(".")
            if len(octets) == 4 and all(o.isascii() and o.isdecimal() and len(o) <= 3 and int(o) <= 255 for o in octets):
                out[a + 1 : b] = [(lo, hi, "" if new in (" ", "-") and not (text[lo - 1].isdecimal() or text[hi].isdecimal()) else new) for lo, hi, new in part]
    return out


def at_and_dot(tape: Tape) -> None:
    """`name at host dot org`, `name [at] host [dot] org`, `name arroba host punto org` and the like become an address; likewise dots of an IP.

    Each at-mark is looked at once: the host must follow it, then the name is matched back from it.
    """
    text, edits, done = tape.text, [], 0
    for m in _AT_MARK.finditer(text):
        start, end = m.span()
        while start > max(done, m.start() - _SPACES) and text[start - 1].isspace():
            start -= 1
        while end < min(len(text), m.end() + _SPACES) and text[end].isspace():
            end += 1
        foreign = m[1] or m[2]
        a_name, a_host, dot_part, dot_word = _ANY_TONGUE if foreign else _ENGLISH
        host = a_host.match(text, end)
        if m.start() < done or not host or not _TOP.search(host[0]):
            continue
        name = a_name.search(text[max(done, start - _NAME_SIZE) : start])
        whole = text[start - len(name[0]) : host.end()] if name else ""
        if whole and (foreign or any(c in whole for c in "[({<@") or dot_word.search(whole)):  # "at" alone between words of a sentence is no disguise
            edits += [(x.start(), x.end(), ".") for x in dot_part.finditer(text, start - len(name[0]), start)]
            edits.append((start, end, "@"))
            edits += [(x.start(), x.end(), ".") for x in dot_part.finditer(text, end, host.end())]
            done = host.end()
    edits += [(x.start(), x.end(), ".") for m in _DISGUISED_IP.finditer(text) for x in _DOT_PART.finditer(text, m.start(), m.end())]
    merged, at = [], -1
    for e in sorted(edits):
        if e[0] >= at and text[e[0] : e[1]] != e[2]:
            merged.append(e)
            at = e[1]
    tape.rewrite(merged)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those together with what the transducers uncover; a base span is never replaced or doubled."""
    base = base_spans(text)
    tape = Tape(text)
    if "&" in text:
        references(tape)
    plain_letters(tape)
    stops(tape)
    lettered_digits(tape)
    if may_be_spelled(tape.text):
        spelled_digits(tape)
    if may_be_addressed(tape.text):
        at_and_dot(tape)
    if tape.text == text:
        return base, base
    # base spans of a kind do not overlap, so each is in order of start and of end
    ends = [[e for _, k, e in base if k == kind] for kind in range(len(KINDS))]
    starts = [[s for s, k, _ in base if k == kind] for kind in range(len(KINDS))]
    more = []
    for start, kind, end in base_spans(tape.text):
        lo, hi = min(tape.starts[start:end]), max(tape.ends[start:end])
        if bisect_right(ends[kind], lo) >= bisect_left(starts[kind], hi):
            more.append((lo, kind, hi))
    return base, sorted(base + more)


def write(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every found range replaced by the name of its first kind in brackets; overlapping ranges are one."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text_col: str = "text", clean_col: str | None = None) -> DataFrame:
    """docs without its text column, with n_email, n_ip, n_card, n_phone (base spans), base_spans, spans and, if named, the redacted text.

    Spans are `kind:start:end` in code points of the source, by start, then kind, comma-joined. A null
    text counts as empty and has none; its redacted text stays null. Texts are handled whole and row by
    row, so any order, repetition or size of rows gives the same result; time grows with the length of a text. Columns named like the results
    are replaced.
    """
    names = [*(f"n_{k}" for k in KINDS), "base_spans", "spans", *([clean_col] if clean_col else [])]
    kept = [c for c in docs.columns if c != text_col and c not in names]
    types = [T.LongType()] * 4 + [T.StringType()] * (len(names) - 4)
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in zip(names, types, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(len(kept)).to_pylist():
                base, spans = all_spans(text or "")
                row = [sum(s[1] == k for s in base) for k in range(4)] + [write(base), write(spans)]
                rows.append(row + [redact(text, spans) if text else text] if clean_col else row)
            made = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *names])

    return map_batches(docs.select(*kept, F.col(text_col).alias("text_")), run, schema)
