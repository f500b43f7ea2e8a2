"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.base import checkpoint, map_batches

_WORDS = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    """Lower-cased words with one space between: layout and punctuation cost no edits."""
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def bounded(words: str) -> str:
    """Normalised words between spaces, so that what is matched begins and ends at words; half a word costs edits."""
    return f" {words} " if words else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """Cut an item into budget + 1 pieces of nearly equal length, with their offsets: `budget` edits leave one piece whole."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, window: str) -> tuple[int, int]:
    """Least edit distance of the item to any part of the window, and where that part ends (Myers, bit-parallel)."""
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        places[c] |= 1 << i
    ones, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = ones, 0, len(item)
    best, end = score, 0
    for k, c in enumerate(window):
        same = places.get(c, 0)
        cross = (((same & up) + up) ^ up) | same
        rise, fall = down | (ones & ~(cross | up)), up & cross
        score += bool(rise & top) - bool(fall & top)
        rise, fall, low = (rise << 1) & ones, (fall << 1) & ones, same | down
        up, down = fall | (ones & ~(low | rise)), rise & low
        if score < best:
            best, end = score, k + 1
    return best, end


class PieceIndex:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, bounded(t), int(len(t) * error_rate)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                places[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item_id -> (least distance, its first end, budget) of every item that occurs within its budget in a normalised text; end is its last word's."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if not self.items or not text:
            return {}
        text = bounded(text)
        for end, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                _, item, budget = self.items[k]
                lo = end + 1 - length - offset - budget
                windows[k].append((max(lo, 0), lo + len(item) + 2 * budget))
        found: dict[int, tuple[int, int, int]] = {}
        for k, spans in windows.items():
            item_id, item, budget = self.items[k]
            spans.sort()
            at, stop = spans[0]
            for lo, hi in [*spans[1:], (1 << 60, 0)]:
                if lo <= at + budget:  # hits of nearly the same alignment are verified together
                    stop = max(stop, hi)
                    continue
                distance, end = best_match(item, text[at:stop])
                if distance <= budget:
                    end += at
                    here = distance, end - 1 - (text[end - 1] == " "), budget
                    found[item_id] = min(here, found.get(item_id, here))
                at, stop = lo, hi
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """Every (doc_id, item_id) where the document holds the item within its error budget, with distance, budget and end_char.

    The budget is `error_rate` edits a character of the normalised item (none below 1/error_rate
    characters: then it must occur exactly). Items begin and end at words: to begin or end inside one costs
    an edit. Of several places the closest counts, then the first; end_char is where it ends in the normalised document.

    Equal normalised items of one id are one. The items are broadcast in blocks of at most `block_chars` characters, put
    together from buckets of a sixteenth by their measured sizes, so that no repeated id or very long item falls in with
    a full block. One block is held against all documents, which are never shuffled. For several,
    the normalised documents are written once to the shared folder; then each block is collected, broadcast, matched,
    written and dropped before the next, so driver and workers hold one. The index of a block is built once in a Python worker.

    Null and blank items match nothing, null and blank texts hold nothing. A null doc_id is reported as
    such, an item without an id is left out. Rows of one document id are matched each on its own; items
    of one id are one item, of which the closer match counts. A very long text is searched in one pass
    over it. No items or no documents give an empty result. Other columns are not read.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, distance int, budget int, end_char int"
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null and item_id is not null")
    items = checkpoint(map_batches(items, _normalised, "id long, text string").where("text <> ''").distinct())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def held_against(rows: list, texts: DataFrame, clean: bool, extra: str) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in rows])
        name, names = uuid.uuid4().hex, ["doc_id", "item_id", "distance", "budget", "end_char", *texts.columns[2:]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, error_rate)
            for batch in batches:
                held = [index.matches(text if clean else normalise(text)) for text in batch.column(1).to_pylist()]
                row = pa.array([k for k, h in enumerate(held) for _ in h], pa.int64())
                out = [(item, d, budget, end) for h in held for item, (d, end, budget) in h.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))), *(c.take(row) for c in batch.columns[2:])], names=names)

        return map_batches(texts, run, schema + extra), shared

    if total <= block_chars:
        return held_against(items.collect(), source, False, "")[0]
    texts = checkpoint(map_batches(source, _normalised, "id long, text string").where("text <> ''").withColumn("row", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], schema + ", row long")
    for block in _blocks(items, total, block_chars):
        part, shared = held_against(block.collect(), texts, True, ", row long")
        found = found.union(checkpoint(part))
        shared.unpersist()
    # texts of one item may stand in several blocks
    best = F.min(F.struct("distance", "end_char", "budget")).alias("best")
    return found.groupBy("row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.distance", "best.budget", "best.end_char")


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(normalise, batch.column(1).to_pylist()), pa.string())], names=["id", "text"])


def _blocks(items: DataFrame, total: int, block_chars: int) -> Iterator[DataFrame]:
    """The items in blocks of whole buckets of a hash of id and text, which hold at most `block_chars` characters where a bucket does."""
    buckets = max(1, 16 * total // block_chars)
    hashed = items.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)))
    sizes = hashed.groupBy("bucket").agg(F.sum(F.length("text")).alias("size")).orderBy("bucket")
    first, held = 0, 0
    for bucket, size in [*sizes.collect(), (buckets, block_chars)]:  # some 16 rows a block
        if held and held + size > block_chars:
            yield hashed.where(F.col("bucket").between(first, bucket - 1)).select("id", "text")
            first, held = bucket, 0
        held += size


_indexes: dict[str, PieceIndex] = {}


def _index(name: str, items: Broadcast, error_rate: float) -> PieceIndex:
    """One index for all tasks of a Python worker: that of the block at hand."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = PieceIndex(items.value, error_rate)
    return _indexes[name]
