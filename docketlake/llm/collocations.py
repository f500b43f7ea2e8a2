"""Phrases whose words keep company: occurrence relations that grow by a word a level."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm import keyfilter
from docketlake.llm.base import checkpoint, map_batches, mix, remove_folder, shared_folder

#: Only A-Z become lower case; a tab is a blank; these characters end a piece.
_UPPER, _ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(_UPPER + b"\t" + _ENDS, _UPPER.lower() + b" " + b"\n" * len(_ENDS))
#: What stands between pieces; no word is equal to it, as it ends pieces itself.
_GAP = b"."
#: Words of one row of a relation, and bytes of text that are split at a time.
CHUNK, SLICE = 1 << 20, 1 << 20
WHOLE = "decimal(38,0)"


class Codes(dict):
    """Numbers words in the order that it meets them; 0 is the gap between pieces."""

    def __init__(self):
        super().__init__({_GAP: 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code

    def of(self, text: str) -> Iterator[np.ndarray]:
        """Codes of the words of a text in order, with a 0 wherever a piece ends."""
        data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
        at = 0
        while at < len(data):
            end = data.find(b" ", at + SLICE)
            end = len(data) if end < 0 else end
            words = data[at:end].replace(b"\n", b" . ").split()
            yield np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))
            at = end
        yield np.zeros(1, dtype=np.int32)


_SCHEMA = "lang string, n_words long, words binary, codes binary"


def _row(lang: str, codes: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([lang], pa.string()), pa.array([int(np.count_nonzero(codes))], pa.int64()), pa.array([b" ".join(words)], pa.binary()), pa.array([codes.astype(np.int32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "n_words", "words", "codes"])


def occurrences(docs: DataFrame, text_col: str, lang_col: str, chunk: int = CHUNK) -> DataFrame:
    """The relation of single words: a row holds the words of some documents of a language in the order of their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Codes, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            words, parts = held.pop(lang)
            del sizes[lang]
            return _row(lang, np.concatenate(parts), list(words))

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                text, lang = text.as_py(), lang.as_py()
                if not text:
                    continue
                lang = "und" if lang is None else lang
                words, parts = held.setdefault(lang, (Codes(), []))
                for codes in words.of(text):
                    parts.append(codes)
                    sizes[lang] = sizes.get(lang, 0) + len(codes)
                if sizes[lang] >= chunk:
                    yield close(lang)
                elif sum(sizes.values()) >= 2 * chunk:  # many languages in a task
                    yield close(max(sizes, key=sizes.__getitem__))
        for lang in list(held):
            yield close(lang)

    return map_batches(docs.select(text_col, lang_col), run, _SCHEMA)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _phrase_keys(lang: str, words: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where `size` words of a piece stand side by side, and a 64-bit key of language and phrase for each.

    Rows are sorted by position, so merging a relation with itself at neighbouring positions takes no search: a run between gaps
    holds only phrases of size - 1 that are in the relation, and two that begin side by side make one of `size`.
    """
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    whole = np.ones(n, dtype=bool)
    for j in range(size):
        whole &= codes[j : j + n] != 0
    places = np.flatnonzero(whole)
    key = np.full(len(places), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=size), dtype=np.uint64)
    for j in range(size):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + words.take(codes.take(places + j)))
    return places, key


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    for batch in batches:
        for lang, words, codes in zip(batch.column("lang"), batch.column("words"), batch.column("codes"), strict=True):
            yield lang.as_py(), words.as_py().split(b" "), np.frombuffer(codes.as_buffer(), dtype=np.int32)


def key_counts(relation: DataFrame, size: int) -> DataFrame:
    """(key, n): occurrences of the phrases of `size` words by key, added up within each row of the relation before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in _opened(batches):
            keys, n = np.unique(_phrase_keys(lang, _hashes(words), codes, size)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return map_batches(relation, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent_only(relation: DataFrame, size: int, kept: Broadcast) -> DataFrame:
    """The relation of phrases of `size` words: those of the smaller relation that pass the filter, in the same order.

    A run of k phrases that begin side by side is written as its k + size - 1 words and a gap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in _opened(batches):
            places, keys = _phrase_keys(lang, _hashes(words), codes, size)
            places = places[keyfilter.has(kept.value, keys)]
            if not len(places):
                continue
            edge = np.flatnonzero(np.diff(places, prepend=-9) > 1)
            first, lengths = places[edge], np.diff(edge, append=len(places)) + size
            ends = np.cumsum(lengths)
            out = codes.take(np.minimum(np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1]), len(codes) - 1))
            out[ends - 1] = 0
            used = np.flatnonzero(np.bincount(out, minlength=1)[1:]) + 1
            renumbered = np.zeros(len(words), dtype=np.int32)
            renumbered[used] = np.arange(1, len(used) + 1)
            yield _row(lang, renumbered.take(out), [_GAP, *(words[k] for k in used.tolist())])

    return map_batches(relation, run, _SCHEMA)


def phrase_counts(relation: DataFrame, size: int) -> DataFrame:
    """(lang, phrase, a): exact counts of the phrases of `size` words of a relation, by their words and not by hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in _opened(batches):
            places, keys = _phrase_keys(lang, _hashes(words), codes, size)
            if not len(places):
                continue
            grams = codes[places[:, None] + np.arange(size)]
            order = np.lexsort([*grams.T[::-1]])  # within a row, phrases are told apart by their words' numbers
            grams = grams[order]
            edge = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
            n = np.diff(edge, append=len(grams))
            text = [b" ".join([words[k] for k in g]) for g in grams[edge].tolist()]
            for k in range(0, len(text), 100_000):
                part = text[k : k + 100_000]
                phrases = pa.array([t.decode("utf-8", "replace") for t in part], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), phrases, pa.array(n[k : k + 100_000].astype(np.int64))], names=["lang", "phrase", "n"])

    return map_batches(relation, run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int, chunk: int = CHUNK, most_bits: int = keyfilter.MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) of all phrases of 1 to `longest` words with a >= least, and (lang, n) of all words.

    Each level reads the relation of the level before, which is sorted by position and written to the shared folder: phrases that
    begin side by side make one more word (no row moves for that), keys are counted, the relation is semi-joined with the
    frequent keys and written, and the phrases left are counted exactly. The semi-join is a filter of bounded size: what it lets pass
    beyond the frequent keys is counted and dropped, so that its size changes the work, not the result. A level's folder goes once the next is written.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"

    def stored(relation: DataFrame, level: int) -> DataFrame:
        relation.write.option("compression", "zstd").parquet(f"{folder}/{level}")
        return spark.read.schema(_SCHEMA).parquet(f"{folder}/{level}")

    relation = stored(occurrences(docs, text_col, lang_col, chunk), 0)
    totals = checkpoint(relation.groupBy("lang").agg(F.sum("n_words").alias("n")))
    levels = []
    for size in range(1, longest + 1):
        often = checkpoint(key_counts(relation, size).where(F.col("n") >= least).select("key"))
        kept = spark.sparkContext.broadcast(keyfilter.build(often, most_bits=most_bits))
        relation = stored(frequent_only(relation, size, kept), size)
        remove_folder(spark, f"{folder}/{size - 1}")
        levels.append(checkpoint(phrase_counts(relation, size).where(F.col("a") >= least).select("lang", F.lit(size).alias("size"), "phrase", "a")))
        kept.unpersist()
    remove_folder(spark, folder)
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    return found, totals


def _words(phrase: str, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def _whole(c: str) -> Column:
    return F.col(c).cast(WHOLE)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, share: int = 80, scale: int = 2_000_000, top: int = 2000, chunk: int = CHUNK, most_bits: int = keyfilter.MOST_BITS) -> DataFrame:
    """The `top` phrases of each language by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A candidate has 2 to `longest` words and occurs a >= least times. Cutting it after its first words gives the counts l and r of both parts and
    floor(scale * a / (l + r)); the cut of the lowest score counts, of equal ones the earliest. Candidates inside a longer candidate that has at
    least `share` per cent of their occurrences are dropped. Ranks go by score, a (both falling) and the phrase's UTF-8 bytes. Products
    are decimals of 38 digits.

    A null text counts as empty, a null language as `und`; rows that repeat count again. A very long text is split slice by
    slice, and its words are spread over as many rows as any. An empty table gives an empty result. Other columns are not read.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, longest, least, chunk, most_bits)
    candidates = found.where("size > 1")
    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", _words("phrase", F.lit(1), F.col("cut"))).withColumn("rest", _words("phrase", F.col("cut") + 1, F.col("size")))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (cast(l as decimal(20,0)) + r)"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    inner = candidates.where("size > 2").select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part"))
    inner = inner.select("lang", "phrase", "part", "a", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)).alias("start"))
    inner = inner.groupBy("lang", _words("phrase", F.col("start"), F.col("part")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = weakest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _whole("longer") < share * _whole("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("at.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("at.l").alias("l"), F.col("at.r").alias("r"), "n", F.col("at.score").alias("score"))
