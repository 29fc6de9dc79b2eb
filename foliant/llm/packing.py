"""Packing of documents into token windows, best fit decreasing.

Token ids are made once, in Arrow batches; what is kept of a document is its pieces (start, length, checksum), written
to the shared checkpoint folder. Best-fit decreasing depends only on how many pieces there are of each length, so the
driver sees at most `window` counts. Runs of equally filled windows are handled together, and a segment tree indexed by
remaining capacity finds the tightest open run. Pieces are ranked within their length by counts of hashed buckets, so a
length that a third of all pieces share is never in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import cut, sliced, strings, table

WINDOW = 1024
#: Pieces of one length are ranked in so many buckets side by side.
RANK_BUCKETS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size-1: the smallest capacity from some value on that has open runs."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << (size - 1).bit_length()
        self.open = [0] * (2 * self.leaves)

    def set(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        self.open[i] = n
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] + self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan_best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank + 1, first window, offset): the pieces of these ranks go to windows one after
    another, at this offset. Longest pieces first, each into the tightest window that has room, else a new one."""
    runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    tree = CapacityTree(window + 1)
    plan, windows = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = window, -(-left // (window // length))
                first, windows = windows, windows + n
            else:
                first, n = runs[room].pop()
            # Best fit stays with a window while it has room, so each takes `deep` pieces; the last may take fewer.
            deep = room // length
            full = min(n, left // deep)
            taken, layers = (full, deep) if full else (1, left)
            if n > taken:
                runs[room].append((first + taken, n - taken))
            tree.set(room, len(runs[room]))
            for layer in range(layers):
                plan.append((length, rank, rank + taken, first, window - room + layer * length))
                rank += taken
            left -= taken * layers
            rest = room - layers * length
            if rest:
                runs[rest].append((first, taken))
                tree.set(rest, len(runs[rest]))
    return plan


def cut_pieces(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Token ids of each whole text and `end_id`, cut into full windows and a rest: PIECES, without the ids themselves.
    A null text is empty, so that its document is the one piece `end_id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from foliant.llm.tokens import ByteBpe

        bpe = ByteBpe(tokenizer_path)
        end = np.array([end_id], "<u4")
        for batch in sliced(batches):
            rows: list[tuple] = []
            texts, ids = strings(batch.column(1)), batch.column(0).to_pylist()
            for doc_id, got in zip(ids, bpe.ids(texts), strict=True):
                got = np.concatenate([got, end])
                for at in range(0, len(got), window):
                    piece = got[at : at + window]
                    rows.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(got)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def assign_windows(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `window` tokens (best fit decreasing). Equal rows are
    interchangeable. No pieces give no rows."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")
    )
    by_bucket = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(by_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_best_fit(counts, window)
    runs = spark.createDataFrame(
        plan or [(-1, 0, 0, 0, 0)], "length long, _first long, _last long, _window long, offset long"
    )
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    # Both sides below are bounded by the window length: window x RANK_BUCKETS counts, and the plan's runs.
    ranked = (
        pieces.withColumn("_at", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["length", "_bucket"])
        .withColumn("_rank", F.col("_at") + F.col("_before"))
    )
    by_length = runs.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("_first", "_last", "_window", "offset"))).alias("_runs")
    )
    run = F.element_at(
        F.filter("_runs", lambda r: (r["_first"] <= F.col("_rank")) & (F.col("_rank") < r["_last"])), 1
    )
    return (
        ranked.join(F.broadcast(by_length), "length")
        .withColumn("_run", run)
        .withColumn("sequence_id", F.col("_run._window") + F.col("_rank") - F.col("_run._first"))
        .withColumn("offset", F.col("_run.offset"))
        .drop("_bucket", "_at", "_before", "_rank", "_runs", "_run")
    )


def pack_documents(
    documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0
) -> DataFrame:
    """All documents as pieces in sequences of at most `window` tokens. Repeated rows are packed once each; an empty
    table gives no rows; other columns are ignored."""
    pieces = cut(cut_pieces(documents, tokenizer_path, window, end_id))
    return assign_windows(pieces, window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def padded_lengths(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored length of each sequence: `window`, but a sequence filled to a power of two stays as it is."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.expr("bit_count(used) = 1")
    return used.withColumn("stored", F.when(power, F.col("used")).otherwise(F.lit(window)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
