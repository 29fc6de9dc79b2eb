"""Tables of runs: rewritten by run, kept in order, appended to by key, and audit rows of runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a log, fixed when it is first written.
LOG_BUCKETS = 64

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; on a cluster that is
    an error, since executors don't share the driver's folders."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", "") or _own_folder
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        named = _own_folder = tempfile.mkdtemp(prefix="foliant-")
    return named.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back, where what made them must not run twice."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, run_id: str, *parts: str, order: Sequence[str] = ()) -> None:
    """Rows of one run, in partitions by run_id and `parts` (e.g. pass_number). Writing a run again replaces the partitions
    it has rows for and leaves other runs, and other parts of this run, as they are. With `order` rows are sorted inside
    their files."""
    rows = df.withColumn("run_id", F.lit(run_id))
    if order:
        rows = rows.sortWithinPartitions("run_id", *parts, *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", *parts).parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Rows of a run, or of the last one by name; other runs' folders aren't listed for their files."""
    rows = spark.read.option("basePath", path).parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    if run_id is None:
        run_id = rows.agg(F.max("run_id")).first()[0]
    return rows.where(F.col("run_id") == F.lit(run_id))


def write_raw_responses(calls: DataFrame, path: str, run_id: str) -> None:
    """Raw texts of a model's answers by run and pass: document_id, pass_number, raw_text."""
    write_table(calls.where("raw_text is not null").select("document_id", "pass_number", "raw_text"), path, run_id, "pass_number")


def write_ordered(df: DataFrame, path: str, *order: Column | str, files: int | None = None) -> None:
    """The rows in ranges of `order`, one file a range, sorted inside: read by file name they are sorted as a whole. No task
    sees more than its range. Ties of all columns of `order` stay together in one file."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """A table of write_ordered with position, counted from 1: rows before a row's file, and its place in that file. There is
    no shuffle of rows, only a count by file, of which there are as many as were written."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = {r["_file"]: r["n"] for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for file in sorted(counts, key=lambda f: (int(f.split("-")[1]), f)):  # part-<number of the range>-...
        starts.append((file, before))
        before += counts[file]
    starts = spark.createDataFrame(starts, "_file string, _start long")
    columns = [c for c in rows.columns if c not in ("_file", "_row")]
    return rows.join(F.broadcast(starts), "_file").select(*columns, (F.col("_start") + F.col("_row") + 1).alias("position"))


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def append_to_log(df: DataFrame, path: str, *key: str, buckets: int = LOG_BUCKETS) -> None:
    """Appends the rows whose key the log doesn't have yet; repeating a call adds nothing. Of new rows that share a key the
    first in the order of all their columns is written. The log is in buckets by hash of the key, and only those are read
    that new keys fall in. One writer at a time: two at once may both add a key."""
    spark, names = df.sparkSession, list(key)
    new = df.groupBy(*names).agg(F.min(F.struct(*[c for c in df.columns if c not in names] or names)).alias("_r"))
    rest = [F.col(f"_r.`{c}`").alias(c) for c in df.columns if c not in names]
    new = new.select(*names, *rest).select(*df.columns).withColumn("bucket", bucket_of(names, buckets))
    if exists(spark, path):
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
        log = read_log(spark, path, touched).select("bucket", *names)
        new = new.join(log.hint("merge"), ["bucket", *names], "left_anti").select(*df.columns, "bucket")
    new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_log(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """A log's rows, or those of some of its buckets; the folders of the others are not read."""
    rows = spark.read.parquet(path)
    return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))


def replace_parts(df: DataFrame, path: str, part: str) -> None:
    """Writes anew the partitions that the rows fall in, also if the rows are read from there."""
    spark, aside = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(aside)
    rows = spark.read.schema(df.schema).parquet(aside)
    rows.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    remove(spark, aside)


def compact_log(spark: SparkSession, path: str) -> None:
    """One file a bucket in place of one an append. Rows stay the same."""
    replace_parts(spark.read.parquet(path), path, "bucket")


AUDIT = "run_id string, seq long, command string, mode string, status string, counts map<string,long>"


def write_run_manifest(spark: SparkSession, path: str, run_id: str, seq: int, command: str, mode: str, status: str, counts: dict[str, int]) -> None:
    """One audit row of a run; a later one (higher seq) of the same run takes its place when read."""
    append_to_log(spark.createDataFrame([(run_id, seq, command, mode, status, counts)], AUDIT).withColumn(
        "counts", F.to_json("counts")), path, "run_id", "seq", buckets=1)


def read_run_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last audit row of each run."""
    rest = ("command", "mode", "status", "counts")
    rows = spark.read.parquet(path).groupBy("run_id").agg(F.max(F.struct("seq", *rest)).alias("r")).select("run_id", "r.*")
    return rows.withColumn("counts", F.from_json("counts", "map<string,long>"))
