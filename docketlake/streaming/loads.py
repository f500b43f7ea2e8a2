"""Incremental loads and streaming checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketlake.operators.merge import merge_keyed

C = F.col


def incremental_load(spark: SparkSession, landing: str, schema: str, keys: list[str], root: str, checkpoint: str, files_per_batch: int = 100, buckets: int = 64) -> StreamingQuery:
    """Load landed JSON files batch by batch into a snapshot of key buckets under root.

    A batch merges its rows (the last delivery of a key wins, by its own order of file and line) into the
    buckets that they touch, writes these to a folder of its own, and moves a pointer to the files of all buckets
    into place last. Readers see the snapshot before or after a batch. A batch that was published is not run again;
    one that was lost before that leaves an unused folder (see vacuum). Runs until all landed files are read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        versions = _versions(spark, root)
        if number in versions:
            return
        folders = _folders(spark, root, max(versions)) if versions else {}
        numbered = batch.withColumn("line_", F.monotonically_increasing_id())  # ascends within a block of a file
        rows = numbered.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct("file_", "block_", "line_")).alias("r")).select("r.*").drop("file_", "block_")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = rows.withColumn("bucket_", bucket).persist()
        touched = sorted(x[0] for x in rows.select("bucket_").distinct().collect())  # at most `buckets` numbers
        held = [folders[b] for b in touched if b in folders]
        rows = rows.drop("bucket_")
        merged = merge_keyed(spark.read.schema(schema).parquet(*held), rows, keys) if held else rows
        folder = f"{root}/data/{number}-{uuid.uuid4().hex}"
        merged.withColumn("bucket_", bucket).write.partitionBy("bucket_").parquet(folder)
        _publish(spark, root, number, folders | {b: f"{folder}/bucket_={b}" for b in touched})
        rows.unpersist()

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landing)
    source = source.withColumn("file_", F.col("_metadata.file_path")).withColumn("block_", F.col("_metadata.file_block_start"))
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at, _ = _files(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, by the names of their pointers."""
    return [int(name[2:]) for name in _names(spark, f"{root}/current") if name.startswith("v=")]


def _folders(spark: SparkSession, root: str, version: int) -> dict[int, str]:
    return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder string").json(f"{root}/current/v={version}").collect()}


def _publish(spark: SparkSession, root: str, version: int, folders: dict[int, str]) -> None:
    """Write the pointer aside and rename it into place."""
    aside = f"{root}/pending/{uuid.uuid4().hex}"
    spark.createDataFrame(list(folders.items()), "bucket int, folder string").coalesce(1).write.json(aside)
    files, at, path = _files(spark, aside)
    files.mkdirs(path(f"{root}/current"))
    if not files.rename(at, path(f"{root}/current/v={version}")):
        raise OSError(f"version {version} could not be published")


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The last snapshot that incremental_load() published under root; its pointer is found by listing, and only its files are read."""
    return spark.read.parquet(*_folders(spark, root, max(_versions(spark, root))).values())


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last `keep` published versions uses, and older pointers; to be called while no load runs."""
    versions = sorted(_versions(spark, root))
    used = {f.rsplit("/", 2)[-2] for v in versions[-keep:] for f in _folders(spark, root, v).values()}
    gone = [f"{root}/data/{n}" for n in _names(spark, f"{root}/data") if n not in used] + [f"{root}/current/v={v}" for v in versions[:-keep]]
    for path in gone:
        files, at, _ = _files(spark, path)
        files.delete(at, True)
    return gone


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; where none is set, a temporary one in local mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-stream-')}/{name}-{uuid.uuid4().hex}"


def deduplicated(stream: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Rows of a stream without repeated deliveries of a key within the lateness."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and read its rows back. Rows, offsets and state go to a new shared_folder()."""
    spark = stream.sparkSession
    root = shared_folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def outage_streaks(stream: DataFrame, key: str, order: str, failed: str, least: int = 3) -> DataFrame:
    """(key, at, n) wherever a source has failed at least `least` times in a row; any other outcome resets the count.

    Runs the stream over what is there and counts over all its rows in order of `order`, whatever files and
    batches brought them. Rows are cut into ranges of key and order; each range is reduced to one
    row a key, its length and its last reset, and only these are put in order, so a frequent key is never in one task.
    """
    rows = run_available(stream.select(C(key).alias("source"), C(order).cast("long").alias("at"), F.coalesce(failed, F.lit(False)).alias("bad")), "landed")
    root = shared_folder(rows.sparkSession, "ranges")
    rows.repartitionByRange("source", "at").withColumn("part", F.spark_partition_id()).write.parquet(root)  # written, as ranges may differ when computed again
    here = Window.partitionBy("source", "part").orderBy("at")
    placed = rows.sparkSession.read.parquet(root).withColumn("place", F.row_number().over(here))
    placed = placed.withColumn("reset", F.coalesce(F.max(F.when(~C("bad"), C("place"))).over(here.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))

    # failures before each range that still count at its start
    ranges = placed.groupBy("source", "part").agg(F.count("*").alias("size"), F.max("reset").alias("last"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("before", F.sum("size").over(upto) - C("size"))
    ranges = ranges.withColumn("open", C("before") + C("size") - F.coalesce(F.max(F.when(C("last") > 0, C("before") + C("last"))).over(upto), F.lit(0)))
    carried = ranges.select(C("source").alias("s"), C("part").alias("p"), F.lag("open", 1, 0).over(Window.partitionBy("source").orderBy("part")).alias("carry"))

    both = placed.join(carried, C("source").eqNullSafe(C("s")) & (C("part") == C("p")))
    n = (C("place") - C("reset") + F.when(C("reset") == 0, C("carry")).otherwise(0)).cast("int")
    return both.where("bad").select(C("source").alias(key), "at", n.alias("n")).where(C("n") >= least)
