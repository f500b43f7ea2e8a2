"""Incremental loads that only write what a batch brings: deltas by partition, merged on read, compacted now and then."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketlake.streaming.loads import _files, _names

C = F.col
ENTRY = "partition string, folder string, batch long, rows long"
PART, ORDER = "part_", "batch_"


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(name[2:]) for name in _names(spark, f"{root}/current") if name.startswith("v="))


def entries(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(partition, folder, batch, rows) of a published version, the last one by default: the folders that hold each partition, and a row without a
    partition for each batch that brought nothing."""
    versions = _versions(spark, root)
    if not versions:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{root}/current/v={versions[-1] if version is None else version}")


def _publish(root: str, listed: DataFrame, version: int) -> None:
    """Write the list of folders aside and rename it into place; one writer at a time."""
    spark = listed.sparkSession
    aside = f"{root}/pending/{uuid.uuid4().hex}"
    listed.coalesce(1).write.json(aside)
    files, at, path = _files(spark, aside)
    place = path(f"{root}/current/v={version}")
    files.mkdirs(path(f"{root}/current"))
    if files.exists(place) or not files.rename(at, place):
        raise OSError(f"version {version} could not be published")


def _write(rows: DataFrame, folder: str, partition: str) -> None:
    rows.withColumn(PART, C(partition)).write.partitionBy(PART).parquet(folder)


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the partitions in a folder, as they stand in paths."""
    return [n for n in _names(spark, folder) if n.startswith(f"{PART}=")]


def append_batch(batch: DataFrame, number: int, keys: list[str], partition: str, root: str, order: list[str]) -> bool:
    """Add a batch as deltas of the partitions that it touches; False if it was published before.

    The last delivery of a key within the batch wins, by `order`, whose columns are not stored. What is written is as large as the batch, whatever has been loaded
    before. Keys are unique within their partition: `partition` is one of the key's columns, or a fixed property of the key.
    """
    spark = batch.sparkSession
    listed = entries(spark, root)
    if listed.where(C("batch") >= number).limit(1).count():
        return False
    kept = [c for c in batch.columns if c not in order]
    by = keys if partition in keys else [*keys, partition]
    rows = batch.groupBy(*by).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("r")).select("r.*").withColumn(ORDER, F.lit(number).cast("long"))
    folder = f"{root}/data/{number}-{uuid.uuid4().hex}"
    _write(rows, folder, partition)
    counts = {r[0]: r[1] for r in spark.read.parquet(folder).groupBy(C(PART).cast("string")).count().collect()} if _parts(spark, folder) else {}  # one row a partition that the batch touches
    new = [(p, f"{folder}/{p}", number, int(counts.get(p.split("=", 1)[1], 0))) for p in _parts(spark, folder)] or [(None, None, number, 0)]
    versions = _versions(spark, root)
    _publish(root, listed.where("partition is not null").union(spark.createDataFrame(new, ENTRY)), versions[-1] + 1 if versions else 0)
    return True


def load_deltas(spark: SparkSession, landing: str, schema: str, keys: list[str], partition: str, root: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Load landed JSON files batch by batch as deltas; a batch that is run again after it was published changes nothing.

    Within a batch, later files and later lines win; between batches the later batch. Runs until all landed files are read.
    """

    def add(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("line_", F.monotonically_increasing_id())  # ascends within a block of a file
        append_batch(numbered, number, keys, partition, root, ["file_", "block_", "line_"])

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landing)
    source = source.withColumn("file_", C("_metadata.file_path")).withColumn("block_", C("_metadata.file_block_start"))
    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest batch of each key."""
    kept = [c for c in rows.columns if c != PART]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), C(ORDER)).alias("r")).select("r.*")


def snapshot(spark: SparkSession, root: str, keys: list[str], partition: str, version: int | None = None, partitions: list[str] | None = None) -> DataFrame:
    """The rows of a published version. Partitions of one folder are read as they are; those with deltas are merged by key, the latest batch first.

    partitions: names (values of the partition column) to read; others are not touched.
    """
    listed = entries(spark, root, version).where("partition is not null")
    if partitions is not None:
        listed = listed.where(F.substring_index("partition", "=", -1).isin(partitions))
    listed = listed.collect()  # one row a partition and delta, which compaction bounds
    folders: dict[str, list[str]] = {}
    for e in listed:
        folders.setdefault(e["partition"], []).append(e["folder"])
    whole = [f[0] for f in folders.values() if len(f) == 1]
    many = [f for fs in folders.values() if len(fs) > 1 for f in fs]
    by = keys if partition in keys else [*keys, partition]
    frames = ([spark.read.parquet(*whole)] if whole else []) + ([_merged(spark.read.parquet(*many), by)] if many else [])
    if not frames:
        raise ValueError(f"nothing has been loaded under {root}")
    return reduce(lambda a, b: a.unionByName(b), frames).drop(ORDER)


def compact(spark: SparkSession, root: str, keys: list[str], partition: str, deltas: int = 8) -> list[str]:
    """Merge the partitions that have at least `deltas` folders into one folder each, and publish; their names.

    Others keep their folders. A partition is rewritten once for every `deltas` batches that touch it, so the bytes written stay within a fixed multiple of what the batches
    bring as long as partitions are of the batches' size (a session that is being loaded). Readers see the version before or after. To be called while no load runs.
    """
    listed = entries(spark, root)
    full = [r[0] for r in listed.where("partition is not null").groupBy("partition").count().where(C("count") >= deltas).collect()]
    if not full:
        return []
    old = [r["folder"] for r in listed.where(C("partition").isin(full)).collect()]
    by = keys if partition in keys else [*keys, partition]
    folder = f"{root}/data/base-{uuid.uuid4().hex}"
    _write(_merged(spark.read.parquet(*old), by), folder, partition)
    last = listed.agg(F.max("batch")).first()[0]
    bases = [(p, f"{folder}/{p}", int(last), 0) for p in _parts(spark, folder)]
    _publish(root, listed.where(C("partition").isNull() | ~C("partition").isin(full)).union(spark.createDataFrame(bases, ENTRY)), _versions(spark, root)[-1] + 1)
    return sorted(full)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last `keep` versions lists, and older versions; to be called while no load runs."""
    versions = _versions(spark, root)
    used = {f.rsplit("/", 2)[-2] for v in versions[-keep:] for (f,) in entries(spark, root, v).where("folder is not null").select("folder").collect()}
    gone = [f"{root}/data/{n}" for n in _names(spark, f"{root}/data") if n not in used] + [f"{root}/current/v={v}" for v in versions[:-keep]]
    for place in gone:
        files, at, _ = _files(spark, place)
        files.delete(at, True)
    return gone
