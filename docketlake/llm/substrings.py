"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.base import checkpoint, map_batches, rolling, text_groups, word_hashes

#: A broadcast filter has about this many bits a key, and at most 2^MOST_BITS in all (128 MB). A fuller filter sends more rows, with the same result.
BITS_A_KEY, MOST_BITS = 16, 30
PREFIX = 6
#: Segments that a task holds to merge copies before it sends them.
SENT_ROWS = 200_000


class Suffixes:
    """The suffixes of some documents, truncated to `width` words and grouped under variable-length prefixes.

    A suffix travels under the least (by hash) of the PREFIX-word prefixes that start within its first
    words; equal suffixes agree on it, and the neighbours that share it travel together as one segment:
    the place of the prefix, 32 bits of each word's hash, and 32 other bits of each suffix's hash, which is
    made of 64-bit hashes of its words. So two suffixes count as equal if 64 bits of their prefix, the codes
    of all words and the check of the whole suffix agree.
    Arrays run over the words of all the texts; no suffix reaches into the next text.
    """

    def __init__(self, texts: list[bytes], width: int):
        self.width = width
        self.hashes, places = word_hashes(b" ".join(texts))
        sizes = np.array([len(t) + 1 for t in texts])
        self.first = np.searchsorted(places, np.cumsum(sizes) - sizes)  # first word of each text
        counts = np.maximum(np.append(self.first[1:], len(places)) - self.first - width + 1, 0)
        total = int(counts.sum())
        self.lo = self.hi = self.at = self.doc = np.empty(0, dtype=np.int64)
        self.prefix = np.empty(0, dtype=np.uint64)
        if total:
            grams = rolling(self.hashes, PREFIX)
            at = np.repeat(self.first - (np.cumsum(counts) - counts), counts) + np.arange(total)  # words that start a suffix
            anchor = _least_place(grams, width - PREFIX + 1)[at]
            cuts = np.concatenate([[0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1, [total]])
            self.lo, self.hi = at[cuts[:-1]], at[cuts[1:] - 1] + 1  # suffixes of each segment
            self.at = anchor[cuts[:-1]]
            self.prefix = grams[self.at]
            self.doc = np.repeat(np.arange(len(texts)), counts)[cuts[:-1]]

    def prefixes(self) -> np.ndarray:
        """The prefixes of each document, once each."""
        order = np.lexsort((self.prefix, self.doc))
        doc, prefix = self.doc[order], self.prefix[order]
        return prefix[np.concatenate([np.ones(min(1, len(doc)), dtype=bool), (doc[1:] != doc[:-1]) | (prefix[1:] != prefix[:-1])])].view(np.int64)

    def segments(self, repeated: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[int, int, bytes, int]]:
        """(document, prefix, segment, first suffix). Prefixes that are not repeated have no inner node and are left out; frequent ones grow to whole windows."""
        live = np.flatnonzero(_has(repeated, self.prefix))
        codes = self.hashes.astype(np.uint32).tobytes()
        long_prefix = _has(frequent, self.prefix[live])
        windows = rolling(self.hashes, self.width)
        checks = (windows >> np.uint64(32)).astype(np.uint32).tobytes()
        windows = windows.view(np.int64)
        columns = (self.doc, self.prefix.view(np.int64), self.lo, self.hi, self.at, self.first[self.doc])
        for doc, prefix, lo, hi, at, first, split in zip(*(c[live].tolist() for c in columns), long_prefix.tolist(), strict=True):
            if split:
                for s in range(lo, hi):
                    yield doc, int(windows[s]), codes[4 * s : 4 * (s + self.width)] + checks[4 * s : 4 * s + 4], s - first
            else:
                yield doc, prefix, bytes((at - lo,)) + codes[4 * lo : 4 * (hi + self.width - 1)] + checks[4 * lo : 4 * hi], lo - first


def _least_place(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least (the first of equals) of each run of `width` values stands."""
    n = len(values) - width + 1
    least, place = values[:n].copy(), np.arange(n)
    for j in range(1, width):
        lower = values[j : j + n] < least
        np.copyto(least, values[j : j + n], where=lower)
        np.copyto(place, np.arange(j, j + n), where=lower)
    return place


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bit set of the keys, put together by Spark and sized by their count; the driver gets at most 2^MOST_BITS bits."""
    size = min(MOST_BITS, max(16, (BITS_A_KEY * keys.count()).bit_length()))
    at = F.col("prefix").bitwiseAND(F.lit((1 << size) - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast((prefix & 63) as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), dtype=np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def deep_nodes(rows: list[tuple[int, bytes, int]], width: int) -> list[tuple[int, int, list[int]]]:
    """(prefix, segment hash, least document of each of its suffixes) for segments whose subtree has repeats.

    rows: (prefix, segment, least document), whole groups. Suffixes are sorted within their group;
    neighbours with a common prefix of `width` words (and equal checks) hang under one inner node of that
    depth, and the least document below the node is that of its leaves.
    """
    if not rows:
        return []
    parts = [np.frombuffer(s[len(s) % 4 :], dtype=np.uint32) for _, s, _ in rows]
    sizes = np.array([len(p) for p in parts])
    counts = (sizes - width + 1) // 2  # k suffixes have k + width - 1 codes and k checks
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(rows)), counts)
    starts = first[owner] + np.arange(counts.sum()) - base[owner]
    columns = np.append(np.arange(width), 0)[None, :] + starts[:, None]
    columns[:, width] += counts[owner] + width - 1
    suffix = np.concatenate(parts)[columns]
    group = np.array([r[0] for r in rows], dtype=np.int64)[owner]
    order = np.lexsort([*suffix.T[::-1], group])
    suffix, group = suffix[order], group[order]
    depth = np.where(group[1:] == group[:-1], np.cumprod(suffix[1:] == suffix[:-1], axis=1).sum(axis=1), 0)
    deep = depth > width  # all words and the check
    node = np.concatenate([[0], np.cumsum(~deep)])
    docs = np.array([r[2] for r in rows], dtype=np.int64)[owner[order]]
    least = np.minimum.reduceat(docs, np.flatnonzero(np.concatenate([[True], ~deep])))[node]
    back = np.empty(len(least), dtype=np.int64)
    back[order] = least
    return [(p, xxhash.xxh3_64_intdigest(s) - (1 << 63), back[b : b + c].tolist()) for (p, s, _), b, c in zip(rows, base.tolist(), counts.tolist(), strict=True)]


def repeated_suffixes(docs: DataFrame, width: int, group_rows: int = 5000, batch_rows: int = 20_000) -> DataFrame:
    """(doc, start): suffixes of (doc, text) whose first `width` words also start in a smaller document."""
    spark = docs.sparkSession

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Suffixes(group, width).prefixes() for _, group in text_groups(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64())], names=["prefix"])

    counted = checkpoint(map_batches(docs.select("text").where("text is not null"), prefixes, "prefix long").groupBy("prefix").count().where("count > 1"))
    filters = spark.sparkContext.broadcast((_filter_of(counted), _filter_of(counted.where(F.col("count") > group_rows))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, bytes], list[int]] = {}  # copies within a task go as one row, but for what fills it

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(p, s, lo, lo != hi) for (p, s), (lo, hi) in least.items()]
            least.clear()
            for k in range(0, len(rows), 20_000):
                part = list(zip(*rows[k : k + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["prefix", "segment", "doc", "more"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, group in text_groups(batch.column(1).to_pylist()):
                for k, prefix, segment, _ in Suffixes(group, width).segments(*filters.value):
                    doc = ids[first + k]
                    seen = least.setdefault((prefix, segment), [doc, doc])
                    seen[:] = min(seen[0], doc), max(seen[1], doc)
                if len(least) >= SENT_ROWS:
                    yield from flush()
        yield from flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple[int, bytes, int]] = []
        prefix, group, rows, more = None, {}, 0, False

        def close() -> None:
            if rows > 1 or more:
                whole.extend((prefix, s, d) for s, d in group.items())

        def flush() -> pa.RecordBatch:
            found = deep_nodes(whole, width)
            whole.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["prefix", "segment", "least"])

        for batch in batches:
            for p, segment, doc, several in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != prefix:
                    close()
                    prefix, group, rows, more = p, {}, 0, False
                    if len(whole) >= batch_rows:
                        yield flush()
                group[segment] = min(doc, group.get(segment, doc))
                rows, more = rows + 1, more or several
        close()
        yield flush()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], batch.column(0).to_pylist()
            for first, group in text_groups(batch.column(1).to_pylist()):
                rows += [(p, xxhash.xxh3_64_intdigest(s) - (1 << 63), ids[first + k], start) for k, p, s, start in Suffixes(group, width).segments(*filters.value)]
            for k in range(0, len(rows), 50_000):
                part = list(zip(*rows[k : k + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=["prefix", "segment", "doc", "start"])

    texts = docs.select("doc", "text").where("text is not null")
    sent = map_batches(texts, send, "prefix long, segment binary, doc long, more boolean")
    trees = map_batches(sent.repartition("prefix").sortWithinPartitions("prefix"), build, "prefix long, segment long, least array<long>")
    here = map_batches(texts, places, "prefix long, segment long, doc long, start long")
    both = here.join(trees, ["prefix", "segment"])
    bits = sum((F.when(F.get("least", F.lit(i)) < F.col("doc"), 1 << i).otherwise(0) for i in range(width - PREFIX + 1)), F.lit(0))
    return both.select("doc", "start", bits.alias("bits")).where("bits > 0")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per input row.

    A word goes if a window of `width` consecutive words that covers it also starts in a document with a
    smaller id. Words are runs of characters other than space and x09-x0D, as they stand; the kept ones
    are joined by one space. Windows are judged on the input.

    Null, empty and blank texts have no words; a text of fewer than `width` words loses none. Rows of one
    id do not count against each other, and each loses what the id's windows cover at those word
    positions. A null id is neither smaller nor larger than another: such rows lose no words and take none
    from others. A very long text is cut into segments like any other; its words are held once in one task.
    An empty table gives an empty result. Other columns are not read. `width` is over PREFIX + 1 and at most 20.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = checkpoint(repeated_suffixes(source.where("doc is not null"), width))
    marks = found.groupBy("doc").agg(F.collect_set(F.struct("start", "bits")).alias("marks"))  # at most one a word
    # documents that lose nothing are not shuffled: a filter of the others is broadcast
    losing = source.sparkSession.sparkContext.broadcast(_filter_of(found.select(F.col("doc").alias("prefix")).distinct()))

    def may_lose(ids: pa.Array) -> np.ndarray:
        return _has(losing.value, ids.fill_null(0).to_numpy().view(np.uint64)) & ids.is_valid().to_numpy(zero_copy_only=False)

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_lose(batch.column(0))))

    def keep_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~may_lose(batch.column(0))))
            words = [text.encode("utf-8", "surrogatepass").split() if text else [] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(np.zeros(len(words), np.int64)), pa.array([b" ".join(w).decode("utf-8", "replace") for w in words], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                if not found:
                    out.append((len(words), 0, b" ".join(words).decode("utf-8", "replace")))
                    continue
                change = np.zeros(len(words) + width + 21, dtype=np.int64)
                for mark in found:
                    for i in range(width - PREFIX + 1):
                        if mark["bits"] >> i & 1:
                            change[mark["start"] + i] += 1
                            change[mark["start"] + i + width] -= 1
                gone = np.cumsum(change)[: len(words)] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_text"])

    result = "doc_id long, n_words long, n_removed long, kept_text string"
    marked = map_batches(source, pass_on, "doc long, text string").join(marks, "doc", "left").select("doc", "text", "marks")
    return map_batches(source, keep_whole, result).union(map_batches(marked, cut, result))
