"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.base import checkpoint, map_batches
from docketlake.llm.graph import components

#: Random signs in the sort key of a pass over all vectors, in that of a pass within a range, and in a sketch.
OUTER_BITS, INNER_BITS, SKETCH_BITS = 60, 32, 128
#: Vectors of a range of a pass, which are held in one task: a quarter of all, within these bounds, and of so many bytes at most (six a component).
LEAST_RANGE, MOST_RANGE, RANGE_BYTES = 1 << 15, 1 << 19, 256 << 20
#: Lengths of vectors whose mean is taken off, the most frequent ones; the least similarity that pairs at the threshold are held to have beyond the mean.
CENTRED, LEAST_BEYOND = 100, 0.25
#: How often the passes within a range may miss a pair at the threshold that the range holds.
INNER_MISS = 0.02
#: Components that are broadcast by id and size (16 bytes each); with more of them Spark splits the skewed side of a sorted join.
BROADCAST_COMPONENTS = 1_000_000


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, one a row; all of one length. Scaled first, so that no square under- or overflows."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(x: Column) -> Column:
    """Whether a vector is not null, empty or zero and holds only finite components."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(fine, F.lit(False))


def needed_passes(rows: int, threshold: float, window: float, miss: float, least: int, found: float = 1.0) -> int:
    """How many passes leave a lone pair at the threshold unmet with a chance of `miss` at most, `least` at least.

    A random sign agrees for the pair with chance p = 1 - acos(threshold) / pi, and vectors evenly spread around their mean fall
    within `window` of each other once about log2(rows / window) leading signs agree; a pair that does is
    found with a chance of `found`.
    """
    meets = found * (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(rows, 1) / window))
    return max(least, math.ceil(math.log(miss) / math.log1p(-meets))) if meets < 1 else least


def range_size(rows: int, dim: int = 64) -> int:
    return max(2, min(MOST_RANGE, max(LEAST_RANGE, rows // 4), RANGE_BYTES // (6 * max(dim, 1))))


def means(points: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """Mean of the unit vectors of each length in dims; sums are added up by component, so the driver gets a number a component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            for dim in np.unique(of).tolist():
                units = _units(batch.column(1).filter(pa.array(of == dim)))
                sums[dim] = sums.get(dim, 0) + np.append(units.sum(axis=0), len(units))
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, dim, dtype=np.int32)), pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(total)], names=["dim", "place", "total"])

    found = map_batches(points.where(F.col("dim").isin(dims)).select("dim", "x"), add, "dim int, place int, total double").groupBy("dim", "place").agg(F.sum("total").alias("total")).toArrow() if dims else pa.table({"dim": [], "place": [], "total": []})
    out = {d: np.zeros(d + 1) for d in dims}
    for dim, place, total in zip(*(c.to_pylist() for c in found.columns), strict=True):
        out[dim][place] = total
    return {d: x[:-1] / max(x[-1], 1) for d, x in out.items()}


def beyond(mean: np.ndarray, threshold: float) -> float:
    """Cosine that a pair at the threshold has once the mean is taken off: what all vectors share says nothing about a pair."""
    shared = min(float(mean @ mean), 0.999)
    return max(LEAST_BEYOND, (threshold - shared) / (1 - shared))


def outer_passes(rows: int, threshold: float, miss: float, dim: int = 64) -> int:
    """Passes over all vectors. A range of a pass is cut anywhere, which costs a pair about one more leading sign."""
    held = range_size(rows, dim)
    return needed_passes(rows, threshold, held / 2 if rows > held else held, miss, 2, 1 - INNER_MISS)


def _planes(dim: int, run: int, bits: int) -> np.ndarray:
    return np.random.default_rng((dim, run, bits)).standard_normal((dim, bits)).astype(np.float32)


def _signs(x: np.ndarray, planes: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
    """The signs of the projections, from that of the mean on, as one number each, first sign highest; at most 64."""
    cut = 0 if mean is None else mean.astype(np.float32) @ planes
    weights = np.uint64(1) << np.arange(planes.shape[1] - 1, -1, -1, dtype=np.uint64)
    out = np.empty(len(x), dtype=np.uint64)
    for k in range(0, len(x), 1 << 14):
        out[k : k + (1 << 14)] = np.where(x[k : k + (1 << 14)] @ planes > cut, weights, np.uint64(0)).sum(axis=1)
    return out


def passes(points: DataFrame, count: int, centres: dict[int, np.ndarray]) -> DataFrame:
    """(run, code, rep, body): in each pass a vector gets the concatenated signs of random projections of its own.

    body is the unit vector in eight bits a component, with its scale and the length of what that leaves out.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                dim, units = int(dim), _units(part.column(2))
                scale = (np.abs(units).max(axis=1, keepdims=True) / 127).astype(np.float32)
                small = np.rint(units / scale).astype(np.int8)
                lost = np.linalg.norm(units - small * scale.astype(np.float64), axis=1).astype(np.float32)[:, None]
                body = np.concatenate([scale.view(np.int8), lost.view(np.int8), small], axis=1)
                body = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((np.arange(len(part) + 1) * body.shape[1]).astype(np.int32)), pa.py_buffer(body.tobytes())])
                for run in range(count):
                    codes = _signs(units.astype(np.float32), _planes(dim, run, OUTER_BITS), centres.get(dim)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim * count + run)), pa.array(codes), part.column(0), body], names=["run", "code", "rep", "body"])

    return map_batches(points.select("rep", "dim", "x"), project, "run long, code long, rep long, body binary")


def range_links(bodies: np.ndarray, seed: int, threshold: float, window: int, mean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows among the vectors of a range: links that span what is surely similar, and pairs too close to tell.

    The range is sorted again and again by short concatenated hashes; neighbours within `window` whose
    sketches differ in few enough signs are compared in eight-bit form, whose error is known.
    """
    n, dim = len(bodies), bodies.shape[1] - 8
    scale, lost = bodies[:, :4].copy().view(np.float32).ravel(), bodies[:, 4:8].copy().view(np.float32).ravel()
    small = bodies[:, 8:]
    x = small.astype(np.float32)
    x *= scale[:, None]
    held_to = threshold if mean is None else beyond(mean, threshold)
    sketch = [_signs(x, _planes(dim, -1 - k & 0xFF, 64)) for k in range(SKETCH_BITS // 64)]
    differ = math.acos(threshold) / math.pi * SKETCH_BITS
    most = math.ceil(differ + 4.5 * math.sqrt(differ * (1 - differ / SKETCH_BITS)))
    root, spanning, close = np.arange(n), [], []
    for run in range(needed_passes(n, held_to, window, INNER_MISS, 1)):
        order = np.argsort(_signs(x, _planes(dim, (seed << 16) + run, INNER_BITS), mean), kind="stable")
        here = [s[order] for s in sketch]
        for d in range(1, min(window, n - 1) + 1):
            far = sum(np.bitwise_count(s[d:] ^ s[:-d]).astype(np.uint16) for s in here)
            near = np.flatnonzero(far <= most)
            a, b = order[near], order[near + d]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            cosine = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 8192]], x[b[k : k + 8192]]) for k in range(0, len(a), 8192)])
            slack = lost[a] + lost[b] + lost[a] * lost[b] + np.float32(1e-4)
            sure = cosine >= threshold + slack
            unsure = ~sure & (cosine >= threshold - slack)
            close.append(np.stack([a[unsure], b[unsure]], axis=1))
            for i, j in zip(a[sure].tolist(), b[sure].tolist(), strict=True):
                p, q = i, j
                while root[p] != p:
                    root[p] = p = root[root[p]]
                while root[q] != q:
                    root[q] = q = root[root[q]]
                if p != q:
                    root[max(p, q)] = min(p, q)
                    spanning.append((i, j))
            if sure.any():
                while (root[root] != root).any():
                    root = root[root]
    unsure = np.unique(np.sort(np.concatenate([np.empty((0, 2), np.int64), *close]), axis=1), axis=0)
    unsure = unsure[root[unsure[:, 0]] != root[unsure[:, 1]]] if len(unsure) else unsure
    return np.array(spanning, dtype=np.int64).reshape(-1, 2), unsure


def window_links(points: DataFrame, ordered: DataFrame, window: int, threshold: float, held: int, centres: dict[int, np.ndarray]) -> DataFrame:
    """Verified links (a, b) found in the ranges of every pass; each range is at most `held` neighbours of one pass."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, reps, bodies, rows = None, [], [], 0

        def done() -> pa.RecordBatch:
            ids, flat = np.concatenate(reps), np.concatenate(bodies)
            links, unsure = range_links(flat, int(run), threshold, window, centres.get(flat.shape[1] - 8)) if len(ids) > 1 else (np.empty((0, 2), np.int64),) * 2
            both = np.concatenate([links, unsure])
            return pa.RecordBatch.from_arrays([pa.array(ids[both[:, 0]]), pa.array(ids[both[:, 1]]), pa.array(np.arange(len(both)) < len(links))], names=["a", "b", "sure"])

        for batch in batches:
            runs = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if rows and (runs[lo] != run or rows >= held):
                    yield done()
                    reps, bodies, rows = [], [], 0
                run, part = runs[lo], batch.slice(lo, hi - lo)
                reps.append(part.column(1).to_numpy())
                bodies.append(np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.int8).reshape(hi - lo, -1))
                rows += hi - lo
        if rows:
            yield done()

    found = checkpoint(map_batches(ordered.select("run", "rep", "body"), compare, "a long, b long, sure boolean"))
    unsure = found.where("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left, right = points.select(F.col("rep").alias("a"), F.col("x").alias("xa")), points.select(F.col("rep").alias("b"), F.col("x").alias("xb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                yield part.select([0, 1]).filter(pa.array(np.einsum("ij,ij->i", _units(part.column(2)), _units(part.column(3))) >= threshold))

    pairs = unsure.join(left, "a").join(right, "b").where(F.size("xa") == F.size("xb")).select("a", "b", "xa", "xb")
    return found.where("sure").select("a", "b").union(map_batches(pairs, verify, "a long, b long"))


def count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(k1, k2, links): how many vectors each links to within its component, copies counted.

    A component is cut into blocks of about `block` vectors, and each pair of blocks is one small
    matrix product that gives counts only, for both; no pair is written and no component meets in one
    task. A component of one block is sent once.
    """
    sizes = checkpoint(members.groupBy("component_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_COMPONENTS else sizes.hint("merge")
    placed = members.join(sizes, "component_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    sent = placed.select("component_id", "k1", "k2", "copies", "x", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    task = F.xxhash64("component_id", F.size("x"), F.least("mine", "other"), F.greatest("mine", "other"))
    sent = sent.select(task.alias("task"), F.signum(F.col("mine") - F.col("other")).cast("int").alias("side"), "k1", "k2", "copies", "x")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            side, copies, u = t["side"].to_numpy(), t["copies"].to_numpy(), _units(t["x"].combine_chunks())
            left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
            linked = u[left] @ u[right].T >= threshold
            links = np.zeros(len(side), dtype=np.int64)
            if (side == 0).any():  # a block with itself
                np.fill_diagonal(linked, False)
                links[left] = linked @ copies[right]
            else:
                links[left], links[right] = linked @ copies[right], linked.T @ copies[left]
            return pa.RecordBatch.from_arrays([t["k1"].combine_chunks(), t["k2"].combine_chunks(), pa.array(links)], names=["k1", "k2", "links"])

        for batch in batches:
            tasks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1), len(tasks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and tasks[a] != task:
                    yield done()
                    held = []
                task = tasks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    ready = sent.repartition("task").sortWithinPartitions("task")
    return map_batches(ready, multiply, "k1 long, k2 long, links long").groupBy("k1", "k2").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, window: int = 64, block: int = 512, miss: float = 0.001) -> DataFrame:
    """Embedding classes: (vec_id, n_links, component_id, kept), one row per input row.

    Equal vectors are one representative. Hashes are signs of projections from the mean of all vectors on, since what all share tells no
    pair apart; the mean covers all rows. In each pass the representatives are sorted by concatenated random
    hashes and cut into ranges of neighbours, small enough for one task; a range is sorted again by other
    hashes, and each vector is compared with the `window` before it. Verified pairs of all passes are united
    into components, and links are then counted exactly within components. The number of passes grows with
    that of the representatives, so that by calculation a lone pair at the threshold is missed with a
    chance of `miss` at most. Vectors travel in eight bits a component; pairs that this leaves open are verified in double precision.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, as do
    vectors of different lengths. Each row is a vector of its own, also where ids repeat. A row with a null
    id links with nothing, is not counted by others, and has a null component and kept. An empty table
    gives an empty result. Other columns are not read.
    """
    every = vectors.select(F.col(id_col).cast("long").alias("vec"), F.size(vector_col).alias("dim"), F.col(vector_col).alias("x"))
    fine = usable(F.col("x").cast("array<double>")) & F.col("vec").isNotNull()
    exact = F.col("x").cast("array<double>")
    keyed = every.where(fine).withColumn("k1", F.xxhash64("dim", exact)).withColumn("k2", F.xxhash64(F.lit(7), "dim", exact))
    reps = checkpoint(keyed.groupBy("k1", "k2", "dim").agg(F.min("vec").alias("rep"), F.count("*").alias("copies"), F.any_value("x").alias("x")))
    sizes = reps.groupBy("dim").count()
    by_dim = sizes.agg(F.max("count"), F.sum("count"), F.max("dim")).first()
    largest, total, dim = by_dim[0] or 0, by_dim[1] or 0, by_dim[2] or 1
    centres = means(reps, [r["dim"] for r in sizes.orderBy(F.desc("count"), "dim").limit(CENTRED).collect()])
    count, held = outer_passes(largest, min([beyond(m, threshold) for m in centres.values()], default=threshold), miss, dim), range_size(largest, dim)
    ranges = max(1, math.ceil(total * count / held))
    ordered = passes(reps, count, centres).repartitionByRange(ranges, "run", "code", "rep").sortWithinPartitions("run", "code", "rep")
    linked = components(window_links(reps, ordered, window, threshold, held, centres))
    same_id = reps.groupBy("rep").count().where("count > 1").select("rep", "rep").toDF("id", "component_id")  # other vectors of one id
    classes = checkpoint(linked.union(same_id.join(linked, "id", "left_anti")))
    members = reps.join(classes, reps["rep"] == classes["id"]).select("k1", "k2", "copies", "x", "component_id")
    counted = count_links(members, threshold, block)
    by_key = reps.select("k1", "k2", "rep", "copies").join(counted, ["k1", "k2"], "left").join(classes, F.col("rep") == F.col("id"), "left")
    by_key = by_key.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    found = keyed.select("vec", "k1", "k2").join(by_key, ["k1", "k2"]).select(F.col("vec").alias("vec_id"), "n_links", "component_id")
    rest = every.where(~fine).select(F.col("vec").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
