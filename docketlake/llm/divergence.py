"""How far the sources of a language differ in their terms: iceberg counts by growing prefixes, then divergences."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.llm import keyfilter
from docketlake.llm.base import checkpoint, map_batches, remove_folder, shared_folder

#: A-Z become lower case, other bytes than letters and those of characters beyond ASCII part terms.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
#: Bytes of the shortest prefix; each level doubles them.
FIRST = 4
#: Terms of one row of the relation, bytes of text that are split at a time.
CHUNK, SLICE = 1 << 20, 1 << 20
#: Bytes of different terms and sources of one row of the relation for each of its terms.
TERM_BYTES = 8
#: Bytes of a row group of the relation's files, which a reader holds at a time, and of a batch that goes to Python.
GROUP_BYTES, BATCH_BYTES = 8 << 20, 8 << 20
#: Sources and terms of a block of the comparison of pairs.
TILE, BLOCK_TERMS = 256, 4096
#: Kept terms and sources that are numbered for a broadcast (64 MB).
MOST_NUMBERED = 1_000_000


class Codes(dict):
    """Numbers terms in the order that it meets them, and adds up their lengths."""

    held = 0

    def __missing__(self, term: bytes | str) -> int:
        code = self[term] = len(self)
        self.held += len(term)
        return code

    def of(self, text: str) -> Iterator[np.ndarray]:
        data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
        at = 0
        while at < len(data):
            end = data.find(b" ", at + SLICE)
            end = len(data) if end < 0 else end
            terms = data[at:end].split()
            yield np.fromiter(map(self.__getitem__, terms), dtype=np.int32, count=len(terms))
            at = end


def _packed(x: np.ndarray | list[int]) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs; the first byte says how many."""
    x = np.asarray(x, dtype=np.int64)
    narrow = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([narrow.itemsize]) + narrow.tobytes()


def _unpacked(blob: pa.Buffer) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"u{memoryview(blob)[0]}", offset=1).astype(np.int64)


class _Held:
    """Documents of one language until they fill a row. Its size counts terms and documents, and the bytes of different terms and sources."""

    def __init__(self):
        self.codes, self.sources = Codes(), Codes()
        self.owner: list[int] = []  # number of each document's source
        self.parts: list[tuple[int, np.ndarray]] = []
        self.count = 0

    @property
    def size(self) -> int:
        return max(self.count, (self.codes.held + self.sources.held) // TERM_BYTES)

    def add(self, source: str, text: str) -> None:
        doc = len(self.owner)
        self.owner.append(self.sources[source])
        self.count += 1
        for codes in self.codes.of(text):
            self.parts.append((doc, codes))
            self.count += len(codes)

    def row(self, lang: str) -> pa.RecordBatch:
        terms = list(self.codes)
        order = sorted(range(len(terms)), key=terms.__getitem__)
        place = np.empty(len(terms), dtype=np.int64)
        place[order] = np.arange(len(terms))
        docs = np.repeat([d for d, _ in self.parts], [len(c) for _, c in self.parts]).astype(np.int64)
        codes = np.concatenate([c for _, c in self.parts]) if self.parts else np.empty(0, dtype=np.int32)
        pairs, n = np.unique(place.take(codes) * len(self.owner) + docs, return_counts=True)
        term, doc = np.divmod(pairs, len(self.owner))
        blobs = [_packed(x) for x in (self.owner, np.bincount(term, minlength=len(terms)), doc, n)]
        columns = [pa.array([lang], pa.string()), pa.array([list(self.sources)], pa.list_(pa.string())), pa.array([b" ".join(terms[k] for k in order)], pa.binary()), *(pa.array([b], pa.binary()) for b in blobs)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "sources", "terms", "owner", "times", "doc", "n"])


_SCHEMA = "lang string, sources array<string>, terms binary, owner binary, times binary, doc binary, n binary"


def occurrences(docs: DataFrame, text_col: str, lang_col: str, source_col: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of some documents of a language: their terms in byte order, and (document, count) sorted by term with the number of documents of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        for batch in batches:
            for text, lang, source in zip(*batch.columns, strict=True):
                lang = lang.as_py() or ""
                one = held.setdefault(lang, _Held())
                one.add(source.as_py() or "", text.as_py() or "")
                if one.size >= chunk:
                    yield held.pop(lang).row(lang)
                elif sum(h.size for h in held.values()) >= 2 * chunk:  # many languages in a task
                    full = max(held, key=lambda k: held[k].size)
                    yield held.pop(full).row(full)
        for lang, one in held.items():
            yield one.row(lang)

    return map_batches(docs.select(text_col, lang_col, source_col), run, _SCHEMA)


def stored(relation: DataFrame, folder: str) -> DataFrame:
    """The relation as files of small row groups. Spark writes and reads a row group at a time; by default its size is looked at after 100 rows only, which are most of a split here."""
    options = {"compression": "zstd", "parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    relation.write.options(**options).parquet(folder)
    return relation.sparkSession.read.schema(_SCHEMA).parquet(folder)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile sends Python at most about BATCH_BYTES at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _key(lang: bytes, prefix: bytes) -> int:
    """64-bit key of a language and a prefix; a language has no 0x00 before its end."""
    return xxhash.xxh3_64_intdigest(lang + b"\x00" + prefix)


def _opened(batches: Iterator[pa.RecordBatch], counts: bool = False) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            blob = lambda name: _unpacked(batch.column(name)[k].as_buffer())  # noqa: E731, B023
            lang, terms = batch.column("lang")[k].as_py(), batch.column("terms")[k].as_py().split()
            term = np.repeat(np.arange(len(terms)), blob("times"))
            yield lang, terms, term, blob("doc"), *((batch.column("sources")[k].as_py(), blob("owner"), blob("n")) if counts else ())


def _alive(lang: str, terms: list[bytes], width: int, kept: np.ndarray | None) -> list[int]:
    """Terms of at least `width` bytes whose prefix of `width` bytes passed; terms of an equal prefix stand side by side."""
    long_enough = [k for k, t in enumerate(terms) if len(t) >= width]
    if kept is None or not long_enough:
        return long_enough
    own, last, keys, of = lang.encode("utf-8", "surrogatepass"), None, [], []
    for k in long_enough:
        prefix = terms[k][:width]
        if prefix != last:
            keys.append(_key(own, prefix))
            last = prefix
        of.append(len(keys) - 1)
    return np.array(long_enough)[keyfilter.has(kept, np.array(keys, dtype=np.uint64)).take(of)].tolist()


def prefix_counts(relation: DataFrame, width: int, before: int, kept) -> DataFrame:
    """(lang, prefix, n_docs): documents that hold a term with this prefix of `width` bytes, or this shorter term and a 0x00.

    Only terms whose prefix of `before` bytes passed the filter are extended. A document is in one row of the relation, so rows count their own documents, each once for a prefix, and the sums are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, terms, term, doc in _opened(batches):
            alive = _alive(lang, terms, before, kept.value if kept else None)
            if not alive:
                continue
            group = np.full(len(terms), -1, dtype=np.int64)
            prefixes: list[bytes] = []
            for k in alive:
                prefix = (terms[k] + b"\x00")[:width]
                if not prefixes or prefixes[-1] != prefix:
                    prefixes.append(prefix)
                group[k] = len(prefixes) - 1
            of = group.take(term)
            n_docs = int(doc.max()) + 1
            pairs = np.sort(of[of >= 0] * n_docs + doc[of >= 0])
            n = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] // n_docs, minlength=len(prefixes))
            for k in range(0, len(prefixes), 100_000):
                part = prefixes[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array(n[k : k + 100_000].astype(np.int64))], names=["lang", "prefix", "n"])

    return map_batches(relation.select("lang", "terms", "times", "doc"), run, "lang string, prefix binary, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n_docs"))


def _filter(rows: DataFrame, most_bits: int) -> np.ndarray:
    """Filter of (lang, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(lang.encode("utf-8", "surrogatepass"), prefix) for lang, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64))], names=["key"])

    return keyfilter.build(map_batches(rows.select("lang", "prefix"), run, "key long"), most_bits=most_bits)


def kept_terms(relation: DataFrame, least: int, most_bits: int = keyfilter.MOST_BITS) -> DataFrame:
    """(lang, term, n_docs) of the terms in at least `least` documents of a language.

    Prefixes grow from level to level, 4, 8, 16 bytes and so on. A prefix in too few documents goes with all its terms; a term that ends within the prefix is complete, and is kept if enough documents hold it. The last level is the one that leaves no longer prefix.
    Prefixes pass to the next level as a filter of bounded size; what it lets pass besides is counted and dropped there, so that its size changes the work and not the result.
    """
    spark = relation.sparkSession
    done, kept, before, width = [], None, 0, FIRST
    while True:
        found = checkpoint(prefix_counts(relation, width, before, kept).where(F.col("n_docs") >= least))
        ended = F.expr("substring(prefix, -1, 1) = X'00'")
        done.append(found.where(ended).select("lang", F.expr("cast(substring(prefix, 1, octet_length(prefix) - 1) as string)").alias("term"), "n_docs"))
        growing = found.where(~ended)
        if kept:
            kept.unpersist()
        if growing.isEmpty():
            break
        kept = spark.sparkContext.broadcast(_filter(growing, most_bits))
        before, width = width, 2 * width
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


class _Numbers:
    """Numbers of (lang, name), found by 64-bit keys and told apart by the names themselves."""

    def __init__(self, rows: pa.Table):
        self.lang, self.name = (c.combine_chunks().cast(pa.binary()) for c in rows.columns)
        keys = [np.array([_key(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], dtype=np.uint64) for b in pa.table([self.lang, self.name], names=["lang", "name"]).to_batches(max_chunksize=50_000)]
        keys = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def clash(self) -> bool:
        return bool((self.keys[1:] == self.keys[:-1]).any())

    def of(self, lang: bytes, names: list[bytes]) -> np.ndarray:
        """The number of each name, -1 where it has none."""
        if not names or not len(self.keys):
            return np.full(len(names), -1, dtype=np.int64)
        keys = np.array([_key(lang, x) for x in names], dtype=np.uint64)
        at = self.order.take(np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1))
        same = pc.and_(pc.equal(self.name.take(pa.array(at)), pa.array(names, pa.binary())), pc.equal(self.lang.take(pa.array(at)), pa.scalar(lang, pa.binary())))
        return np.where(same.to_numpy(zero_copy_only=False), at, -1)

    def names(self, numbers: np.ndarray) -> list[pa.Array]:
        return [c.take(pa.array(numbers)).cast(pa.string()) for c in (self.lang, self.name)]


def source_counts(relation: DataFrame, terms: DataFrame, names: DataFrame, most_bits: int = keyfilter.MOST_BITS, most_numbered: int = MOST_NUMBERED) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms in each source.

    While terms and names (lang, source) are at most `most_numbered`, and of at most 64 bytes each on average, they are broadcast with numbers, and pairs of numbers are counted;
    beyond that, or if two of them have one 64-bit key, the words themselves travel, those that pass a filter of bounded size, and are joined with the kept ones. Both give the same rows.
    """
    size = terms.agg(F.count("*"), F.sum(F.octet_length("term") + F.octet_length("lang"))).union(names.agg(F.count("*"), F.sum(F.octet_length("source") + F.octet_length("lang")))).toPandas()
    if size.iloc[:, 0].sum() <= most_numbered and size.iloc[:, 1].fillna(0).sum() <= 64 * most_numbered:
        numbered = [_Numbers(rows.toArrow()) for rows in (terms.select("lang", "term"), names.select("lang", "source"))]
        if not any(x.clash() for x in numbered):
            return _counts_by_number(relation, *numbered)
    return _counts_by_word(relation, terms, most_bits)


def _counts_by_number(relation: DataFrame, words: _Numbers, groups: _Numbers) -> DataFrame:
    shared = relation.sparkSession.sparkContext.broadcast((words, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, groups = shared.value
        for lang, names, term, doc, sources, owner, n in _opened(batches, counts=True):
            own = lang.encode("utf-8", "surrogatepass")
            number = words.of(own, names).take(term)
            group = groups.of(own, [s.encode("utf-8", "surrogatepass") for s in sources])
            some = number >= 0
            pairs, at = np.unique(group.take(owner.take(doc[some])) << 32 | number[some], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.bincount(at, weights=n[some], minlength=len(pairs)).astype(np.int64))], names=["pair", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, groups = shared.value
        for batch in batches:
            pair = batch.column(0).to_numpy()
            columns = groups.names(pair >> 32) + words.names(pair & 0xFFFFFFFF)[1:]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["lang", "source", "term", "n"])

    found = map_batches(relation, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return map_batches(found, named, "lang string, source string, term string, n long")


def _counts_by_word(relation: DataFrame, terms: DataFrame, most_bits: int) -> DataFrame:
    ends = terms.select("lang", F.expr("cast(term as binary) || X'00'").alias("prefix"))
    kept = terms.sparkSession.sparkContext.broadcast(_filter(ends, most_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, term, doc, sources, owner, n in _opened(batches, counts=True):
            own = lang.encode("utf-8", "surrogatepass")
            wanted = keyfilter.has(kept.value, np.array([_key(own, t + b"\x00") for t in names], dtype=np.uint64)) if names else np.empty(0, dtype=bool)
            some = wanted.take(term)
            pairs, at = np.unique(term[some] * len(sources) + owner.take(doc[some]), return_inverse=True)
            counts = np.bincount(at, weights=n[some], minlength=len(pairs)).astype(np.int64)
            for k in range(0, len(pairs), 100_000):
                part = pairs[k : k + 100_000]
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([sources[i] for i in (part % len(sources)).tolist()], pa.string()), pa.array([names[i].decode("utf-8", "replace") for i in (part // len(sources)).tolist()], pa.string()), pa.array(counts[k : k + 100_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n"])

    found = map_batches(relation, run, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return found.join(terms.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")


def _share(n: Column, total: str, kinds: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * kinds)), exactly."""
    d = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", (d(n) + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), d(F.col(total)) + d(F.col(kinds)) * 2) + 1


def _gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so that 64 bits hold the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def pair_sums(shares: DataFrame, groups: DataFrame, tile: int = TILE, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, other, extra) for source < other by number: what the terms that occur add to the value of a pair in which none occurs.

    shares: (lang, source, term, p); groups: (lang, source, number, p0, kinds). Terms are dealt into blocks of about `block_terms` and sources into
    tiles, and a task compares two tiles over one block, so neither a term nor a source is gathered in one place.
    """
    blocks = F.expr(f"cast(kinds div {block_terms} + 1 as int)")
    tiles = groups.groupBy("lang").agg((F.floor(F.max("number") / tile) + 1).cast("int").alias("tiles"))
    of = groups.withColumn("blocks", blocks).join(tiles, "lang")
    every = of.where("kinds > 0").select("lang", "number", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    some = shares.join(of.drop("kinds", "p0"), ["lang", "source"]).select("lang", "number", "term", "p", "tiles", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"))
    own = F.floor(F.col("number") / tile).cast("int")
    rows = every.union(some).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "block", "number", "term", "p")

    def compare(rows: pa.Table) -> pa.Table:
        number, p, term = rows["number"].to_numpy(), rows["p"].to_numpy(), rows["term"].combine_chunks().dictionary_encode()
        lang, low, high = (rows[c][0].as_py() for c in ("lang", "low", "high"))
        none = rows["term"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        numbers, at = np.unique(number, return_inverse=True)
        base = np.zeros(len(numbers), dtype=np.int64)
        base[at[none]] = p[none]
        m = np.repeat(base[:, None], len(term.dictionary), axis=1)
        m[at[~none], term.indices.to_numpy(zero_copy_only=False)[~none].astype(np.int64)] = p[~none]
        gap = lambda x, y: (x - y) * (x - y) // (x + y)
        a, b, extra = [], [], []
        for k in range(len(numbers)):
            if numbers[k] // tile == low:
                rest = slice(k + 1, None) if low == high else slice(int(np.searchsorted(numbers, high * tile)), None)
                sums = (gap(m[k][None, :], m[rest]) - gap(base[k], base[rest])[:, None]).sum(axis=1)
                a.append(np.full(len(sums), numbers[k]))
                b.append(numbers[rest])
                extra.append(sums)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, dtype=np.int64), pa.int64())
        out = pa.table({"a": cat(a), "b": cat(b), "extra": cat(extra)})
        return out.add_column(0, "lang", pa.array([lang] * out.num_rows, pa.string()))

    found = rows.groupBy("lang", "low", "high", "block").applyInArrow(compare, "lang string, a long, b long, extra long")
    return found.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10, chunk: int = CHUNK, most_bits: int = keyfilter.MOST_BITS, tile: int = TILE, block_terms: int = BLOCK_TERMS, most_numbered: int = MOST_NUMBERED) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms from the language.

    A language keeps the terms in at least `least` of its documents (rows). Counts of kept terms, smoothed by 2, give each source and each language
    a share p of each term in parts of 10^9; p and q differ by floor((p - q)^2 / (p + q)). Part `pair` has all other sources with the sum over all kept terms, part `term` the `top`
    terms that occur in the source and are commoner there than in the language. Ranks go by value, falling, then by the item's UTF-8 bytes.

    Null text, language and source count as ''. Rows that repeat count again, as documents too. A very long text is split slice by slice. A source without
    terms has its rows in part `pair`; a language that keeps none has values of 0. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    with small_batches(spark):
        relation = stored(occurrences(docs, text_col, lang_col, source_col, chunk), folder)
        terms = checkpoint(kept_terms(relation, least, most_bits))
        names = checkpoint(relation.select("lang", F.explode("sources").alias("source")).distinct())
        counts = checkpoint(source_counts(relation, terms, names, most_bits, most_numbered))
    remove_folder(spark, folder)

    kinds = terms.groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0, ["total", "kinds"])
    groups = groups.withColumn("p0", F.when(F.col("kinds") > 0, _share(F.lit(0), "total", "kinds")).otherwise(0))
    groups = checkpoint(groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1))
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), "total", "kinds").alias("p"))

    side = lambda name, number, p: groups.select("lang", F.col("source").alias(name), F.col("number").alias(number), F.col("p0").alias(p), "kinds")
    pairs = side("source", "a", "p").join(side("other", "b", "q").drop("kinds"), "lang").where("a < b").join(pair_sums(shares, groups, tile, block_terms), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", "other", F.when(F.col("kinds") > 0, F.col("extra") + F.col("kinds") * _gap("p", "q")).otherwise(0).alias("value"))
    pairs = pairs.union(pairs.select("lang", "other", "source", "value")).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    sizes = whole.groupBy("lang").agg(F.sum("n").alias("total")).join(kinds, "lang")
    common = whole.join(sizes, "lang").select("lang", "term", _share(F.col("n"), "total", "kinds").alias("q"))
    own = shares.join(common, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).union(own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
