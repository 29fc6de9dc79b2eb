"""Structured Streaming forms of the incremental operators. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.sources.tables import LOG_BUCKETS, bucket_of, exists, read_log, replace_parts, stored


def usage_per_day(usage: DataFrame, late: str | None = None) -> DataFrame:
    """Tokens, calls and failures by day. For a stream give the lateness after which rows are dropped."""
    rows = usage.withWatermark("ts", late) if late else usage
    return rows.groupBy(F.window("ts", "1 day")).agg(
        F.sum("total_tokens").alias("tokens"), F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures")
    ).select(F.col("window.start").alias("day"), "tokens", "calls", "failures")


def new_documents(files: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of files (document_id, modified_time, ...) as one row per content within the watermark."""
    return files.withWatermark("modified_time", late).dropDuplicatesWithinWatermark(["document_id"])


#: Lengths of the windows of usage: the day of the quota, a day every six hours, and calls no further apart than the gap.
DAY, STEP, GAP = "1 day", "6 hours", "30 minutes"


def window_of(kind: str, ts: str = "ts") -> Column:
    if kind == "session":
        return F.session_window(ts, GAP)
    return F.window(ts, DAY, STEP) if kind == "sliding" else F.window(ts, DAY)


def usage_windows(usage: DataFrame, kind: str, late: str | None = None) -> DataFrame:
    """Tokens, calls and failures by user and window: tumbling, sliding or session. For a stream give the lateness after
    which a row's window is closed to it. Session windows of a user that come to touch are one."""
    rows = usage.withWatermark("ts", late) if late else usage
    counted = rows.groupBy("user_id", window_of(kind).alias("w")).agg(
        F.sum("total_tokens").alias("tokens"), F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures")
    )
    return counted.select(F.lit(kind).alias("kind"), "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tokens", "calls", "failures")


def with_lateness(usage: DataFrame, arrival: str, late: str, kind: str = "tumbling") -> DataFrame:
    """Adds is_late to rows that came in numbered micro-batches: whether all their windows were closed when they came. A
    stream closes windows by the latest time of all batches but the last two before, less `late`: of those it has read,
    the last one moves the mark and the one before it is when the mark is used for late rows. One row a batch is sorted."""
    newest = usage.groupBy(F.col(arrival).alias("_batch")).agg(F.max("ts").alias("_newest"))
    before = Window.partitionBy(F.lit(0)).orderBy("_batch").rowsBetween(Window.unboundedPreceding, -2)
    marks = newest.withColumn("_mark", F.max("_newest").over(before) - F.expr(f"interval {late}")).select("_batch", "_mark")
    start = F.window("ts", DAY)["start"]
    ends = {"tumbling": start + F.expr(f"interval {DAY}"), "session": F.col("ts") + F.expr(f"interval {GAP}")}
    end = ends.get(kind, F.window("ts", STEP)["start"] + F.expr(f"interval {DAY}"))
    met = usage.join(marks.hint("merge"), F.col(arrival) == F.col("_batch"))
    return met.withColumn("_end", end).withColumn("is_late", F.coalesce(F.col("_end") <= F.col("_mark"), F.lit(False))).drop("_batch", "_mark", "_end")


def latest_answers(log: DataFrame, path: str, checkpoint: str, buckets: int = LOG_BUCKETS):
    """Starts a stream that keeps the last answer by seq of each group and field in `path`.

    The state is one row a key. A batch hands on the keys it changed; only the buckets of the table that these fall in are
    written anew. A batch that is replayed gives the same rows, so a restart loses and doubles nothing. Of answers with one
    seq the greatest counts."""
    keys = ["group_id", "field_key"]
    last = F.max(F.struct("seq", "applied_value")).alias("l")
    keyed = log.groupBy(*keys).agg(last).select(*keys, "l.applied_value", "l.seq")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = stored(batch.withColumn("bucket", bucket_of(keys, buckets)))
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # no more than there are buckets
        if not touched:
            return
        if exists(spark, path):
            changed = changed.unionByName(read_log(spark, path, touched))
        rows = changed.groupBy("bucket", *keys).agg(last).select(*keys, "l.applied_value", "l.seq", "bucket")
        replace_parts(rows, path, "bucket")

    return keyed.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
