"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of one Arrow batch; spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default, bounds its bytes.
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one in local mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """64-bit hashes of words (bytes). Keeps the first `limit` words it meets, which are mostly the frequent ones."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E6C63D0876A9A4B)
    return x ^ (x >> np.uint64(29))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and places of the words of a text (what bytes.split() gives), in order, eight bytes of all words at a time."""
    padded = b" %b        " % text
    chars = np.frombuffer(padded, dtype=np.uint8)
    solid = (chars != 32) & ((chars - np.uint8(9)) > 4)
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place
    out = mix((eights.take(starts) & _MASKS.take(np.minimum(sizes, 8))) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64))
    live, done = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
    while len(live):
        left = sizes.take(live) - done
        part = eights.take(starts.take(live) + done) & _MASKS.take(np.minimum(left, 8))
        out[live] = mix(out.take(live) * np.uint64(0xC2B2AE3D27D4EB4F) + part)
        live, done = live[left > 8], done + 8
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(padded[starts[k] : starts[k] + sizes[k]])
    return out, starts - 1


def text_groups(texts: list[str | None], size: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, encoded texts): neighbours of about `size` bytes together, so that array operations pay; a null text counts as empty."""
    first, group, held = 0, [], 0
    for k, text in enumerate(texts):
        group.append(text.encode("utf-8", "surrogatepass") if text else b"")
        held += len(group[-1])
        if held >= size:
            yield first, group
            first, group, held = k + 1, [], 0
    if group:
        yield first, group


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values, in order; empty when there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)
