"""MinHash near-duplicate detection by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.base import WordHashes, checkpoint, map_batches, mix, rolling
from docketlake.llm.graph import components

#: Bytes of one batch of sets on its way to the nodes. One Arrow column holds at most 2 GB.
SENT_BYTES = 64 << 20
#: Nodes that are broadcast by id and size (16 bytes each); with more of them Spark splits the skewed side of a sorted join.
BROADCAST_NODES = 1_000_000


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashed shingles of a document, ascending. Fewer words than the width make one shingle; none make none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(words)
    return np.unique(rolling(h, width)) if len(h) >= width else mix(rolling(h, len(h)) + np.uint64(len(h)))


def shingle_words(text: str | None) -> list[bytes]:
    """Words between space and x09-x0D, A-Z lower-cased: what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def set_key(members: np.ndarray) -> bytes | None:
    """128-bit digest of a set; None for an empty one."""
    return xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None


def set_mark(key: bytes | None) -> int | None:
    """64 bits of a set's digest: they tell the texts of one id apart, and travel with each path of a document instead of the digest."""
    return int.from_bytes(key[:8], "little", signed=True) if key else None


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, coordinates: int) -> DataFrame:
    """Per document: doc, n (size of its shingle set), set_key (digest of the set, null if empty), mark (64 bits of it) and sig (minwise hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        odd = np.random.default_rng(20).integers(0, 2**62, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(shingle_words(text), width, hashes)
                sizes.append(len(s))
                keys.append(set_key(s))
                sigs.append([int((s * c).min() >> np.uint64(33)) for c in odd] if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(map(set_mark, keys), pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc", "n", "set_key", "mark", "sig"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), run, "doc long, n long, set_key binary, mark long, sig array<int>")


def chosen_path_nodes(reps: DataFrame, trees: int, leaf: int, depth: int, coordinates: int) -> DataFrame:
    """(doc, mark, node): the small nodes in which documents are to be compared.

    Each tree branches a node by a minwise token, one chosen by the node for all its documents; now
    and then by two, so that a pair at the threshold keeps one common path in expectation. Nodes of
    at most `leaf` documents end a path. What is still larger at the last level is cut into blocks,
    and each pair of blocks becomes a node, so no pair of it is lost and no node is large.
    """
    member = ["doc", "mark"]
    work = reps.select(*member, F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.col("sig")[t]).alias("node")) for t in range(trees)])).alias("x")).select(*member, "x.tree", "x.node")
    found = None
    for level in range(1, depth + 1):
        work = checkpoint(work)
        counts = checkpoint(work.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))  # summed before the shuffle
        big = counts.where(F.col("size") > leaf)
        n_big = big.count()
        if n_big <= BROADCAST_NODES:  # members of a hot node stay where they are
            sized = work.join(F.broadcast(big), "node") if n_big else None
            rest = work.join(F.broadcast(big), "node", "left_anti") if n_big else work
        else:
            sized, rest = work.join(big.hint("merge"), "node"), work.join(big.hint("merge"), "node", "left_anti")
        small = rest.join(counts.where(F.col("size") <= leaf), "node").select(*member, "node")
        found = small if found is None else found.union(small)
        if not n_big:
            break
        if level == depth:
            found = found.union(_block_pairs(sized, leaf))
        else:
            work = sized.join(reps.select(*member, "sig"), member).select(*member, "tree", F.explode(_children(level, trees, coordinates)).alias("node"))
    found = checkpoint(found)
    # trees that gathered the same documents ask for the same comparison
    same = found.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("mark")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "mark")).alias("y"))
    once = same.groupBy("size", "x", "y").agg(F.min("node").alias("node")).select("node")
    return found.join(once, "node", "left_semi")


def _children(level: int, trees: int, coordinates: int) -> Column:
    first = (F.lit(level * trees) + F.col("tree")) % coordinates
    second = (F.lit(level * trees) + (F.col("tree") + 1 + F.pmod(F.col("node"), F.lit(trees - 1))).cast("int") % trees) % coordinates
    child = lambda c: F.xxhash64(F.col("node"), c, F.get(F.col("sig"), c))
    return F.when(F.pmod(F.hash("node"), F.lit(100)) < 18, F.array(child(first), child(second))).otherwise(F.array(child(first)))


def _block_pairs(large: DataFrame, leaf: int) -> DataFrame:
    blocks = F.ceil(F.col("size") / leaf).cast("int")
    mine = F.pmod(F.xxhash64("mark", "node"), blocks).cast("int")
    pair = lambda other: F.xxhash64(F.col("node"), F.least("mine", other), F.greatest("mine", other))
    return large.select("doc", "mark", "node", blocks.alias("blocks"), mine.alias("mine")).select("doc", "mark", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("node"))


def links_in_nodes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) that span the similar documents of every node, confirmed on full shingle sets."""
    # at most a few nodes a tree, but for members of a node cut into blocks: one for each block of it
    wanted = nodes.groupBy("doc").agg(F.collect_list(F.struct("mark", "node")).alias("nodes"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            part, out, held = list(zip(*out, strict=True)) or [[], [], []], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "doc", "members"])

        for batch in batches:
            for doc, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(shingle_words(text), width, hashes)
                packed, mark = s.tobytes(), set_mark(set_key(s))
                for x in at:
                    if x["mark"] == mark:  # an id may have several texts
                        out.append((x["node"], doc, packed))
                        held += len(packed) + 16
                        if held >= SENT_BYTES:
                            yield flush()
        yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, docs_in, sets, out = None, [], [], []
        for batch in batches:
            for n, doc, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n != node:
                    out += spanning_links(docs_in, sets, percent)
                    node, docs_in, sets = n, [], []
                docs_in.append(doc)
                sets.append(members)
            if len(out) > 5000:
                yield _edges(out)
                out = []
        out += spanning_links(docs_in, sets, percent)
        yield _edges(out)

    sent = map_batches(texts.select("doc", "text", "nodes"), send, "node long, doc long, members binary")
    return map_batches(sent.repartition("node").sortWithinPartitions("node"), compare, "a long, b long").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def spanning_links(docs: list[int], packed: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Compare all documents of a node; return links enough to connect all that are linked in it."""
    if len(docs) < 2:
        return []
    sizes = np.array([len(p) // 8 for p in packed])
    order = np.argsort(sizes, kind="stable")
    sizes, docs = sizes[order], [docs[i] for i in order]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, ids = np.unique(np.concatenate([np.frombuffer(packed[i], dtype=np.uint64) for i in order]), return_inverse=True)
    mark, root, links = np.zeros(len(values), dtype=np.int64), np.arange(len(docs)), []
    for y in range(len(docs) - 1):
        end = np.searchsorted(sizes, sizes[y] * 100 / percent, "right")  # larger sets cannot reach the threshold
        if end <= y + 1 or (root[y + 1 : end] == root[y]).all():
            continue
        mark[ids[starts[y] : starts[y] + sizes[y]]] = 1
        lo, hi = starts[y + 1], starts[end] if end < len(docs) else len(ids)
        shared = np.add.reduceat(mark[ids[lo:hi]], starts[y + 1 : end] - lo)
        mark[ids[starts[y] : starts[y] + sizes[y]]] = 0
        for z in np.flatnonzero(100 * shared >= percent * (sizes[y] + sizes[y + 1 : end] - shared)) + y + 1:
            if root[z] != root[y]:
                links.append((docs[y], docs[z]))  # of one id, where texts of it are alike
                root[root == root[z]] = root[y]
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, trees: int = 8, leaf: int = 512, depth: int = 4) -> DataFrame:
    """Near-duplicate classes: (doc_id, n_shingles, component_id, kept), one row per input row.

    Two documents are linked when their sets of distinct word 5-shingles have a Jaccard similarity of
    at least `percent` hundredths; a class is what links connect, and its smallest id is kept. Equal
    sets are one representative from the start, so copies cost one row each. Representatives go down
    `trees` independent chosen-path trees; links are confirmed on full sets. A pair at the threshold is missed
    by all eight trees once in four million times where its nodes are small at the first level, and once in about
    1,400 where they stay large down to the last; other links of a class that large mostly connect it all the same.

    Shingles are 64-bit hashes of 64-bit word hashes, and links turn on the full sets of them.

    Null, empty and blank texts have no shingles and are linked with nothing; texts of fewer words than
    `width` are one shingle. Rows of one id are one document: each of its texts is compared, and what any
    of them is linked with joins the class of the id. Rows with a null id are shingled, link nothing, and
    have a null class and kept. A very long text is one row with a set of 8 bytes a word. Other columns are not
    read. An empty table gives an empty result.
    """
    coordinates = trees * depth
    each = checkpoint(signatures(docs, id_col, text_col, width, coordinates))
    named = each.where("set_key is not null and doc is not null")
    groups = checkpoint(named.groupBy("set_key").agg(F.min("doc").alias("rep")))
    reps = checkpoint(named.join(groups.withColumnRenamed("rep", "doc"), ["doc", "set_key"]).dropDuplicates(["doc", "set_key"]).select("doc", "mark", "sig"))
    nodes = checkpoint(chosen_path_nodes(reps, trees, leaf, depth, coordinates))
    links = links_in_nodes(docs, nodes, id_col, text_col, width, percent)
    several = named.groupBy("doc").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("doc")
    same_id = named.join(several, "doc", "left_semi").join(groups, "set_key").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    classes = components(links.union(same_id))
    merged = groups.join(classes, groups["rep"] == classes["id"], "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    # an id with several texts is a node itself
    by_id = several.join(classes, several["doc"] == classes["id"]).select("doc", F.col("component_id").alias("of_id"))
    found = each.select("doc", "n", "set_key").join(merged, "set_key", "left").join(by_id, "doc", "left")
    component = F.when(F.col("doc").isNull() | F.col("set_key").isNull(), F.col("doc")).otherwise(F.coalesce("of_id", "component_id"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
