"""Exact top-k search over quantised vectors with a bit-sliced index.

Rows with equal vectors are one entry with its k + 1 smallest ids, since no other of them can be among the k best. The
entries are dealt to blocks of some thousand; a block's index has a bitmap over its entries for each dimension and each
of the high bits of the component. Queries come in blocks too and meet every index block once. There the score of all
entries is added up, bitmap by bitmap, as a bit-sliced number; the k-th best is found from the most significant slice
downward; entries that the low bits could still lift past it are the boundary, and they are resolved exactly. A block
pair returns k + 1 rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import cut, sliced, table

SCALE, MODULUS, K = 256, 50, 5
BLOCK, QUERY_BLOCK = 4096, 128
#: High bits of a component that have slices; the others are left to the boundary.
SLICED_BITS = 7
#: A double below this is an exact integer after rounding down; a larger one is an integer as it is.
EXACT = float(1 << 53)
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
LARGEST = (1 << 63) - 1


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """64-bit words of the boolean rows in the last axis, whose length is a multiple of 64."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def slice_block(vectors: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(dimension, bit, word) slices of the high bits of all components, the shift that drops the low ones, and the
    offset that makes them non-negative."""
    n, dims = vectors.shape
    bits = max(int(max(vectors.max(), -vectors.min() - 1)).bit_length() + 1, 1) if vectors.size else 1
    shift = max(0, bits - SLICED_BITS)
    offset = 1 << (bits - shift - 1)
    high = np.zeros((dims, -(-n // 64) * 64), np.int64)
    high[:, :n] = ((vectors >> shift).T + offset).astype(np.int64)
    return np.stack([bitmaps((high >> b) & 1 == 1) for b in range(bits - shift)], axis=1), shift, offset


def add_slices(slices: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Slices (query by word), lowest first, of the sum over dimensions of |q| times the offset component, or times its
    complement where q is negative. Carry-save adders, then one ripple-carry addition."""
    dims, bits, words = slices.shape
    columns: list[list[np.ndarray]] = []

    def add(plane: np.ndarray, at: int) -> None:
        while True:
            while len(columns) <= at:
                columns.append([])
            column = columns[at]
            column.append(plane)
            if len(column) < 3:
                return
            a, b, c = column
            half = a ^ b
            columns[at] = [half ^ c]
            plane, at = (a & b) | (half & c), at + 1

    size = np.abs(queries)
    negative = np.where(queries < 0, ONES, np.uint64(0))
    for d in range(dims):
        for j in range(int(size[:, d].max()).bit_length() if len(size) else 0):
            mask = np.where((size[:, d] >> j) & 1 == 1, ONES, np.uint64(0))
            if mask.any():
                for b in range(bits):
                    add((slices[d, b][None, :] ^ negative[:, d][:, None]) & mask[:, None], b + j)
    out, carry = [], np.zeros((len(queries), words), np.uint64)
    for column in columns:
        a, b = [*column, np.zeros_like(carry), np.zeros_like(carry)][:2]
        half = a ^ b
        out.append(half ^ carry)
        carry = (a & b) | (half & carry)
    return [*out, carry]


def kth_best(planes: list[np.ndarray], valid: np.ndarray, k: int) -> list[np.ndarray]:
    """Bits (lowest first, one a query) of the k-th largest sum; 0 if there are fewer entries."""
    above, equal = np.zeros_like(planes[0]), np.broadcast_to(valid, planes[0].shape)
    found = []
    for plane in reversed(planes):
        inside = above | (equal & plane)
        enough = np.bitwise_count(inside).sum(axis=1) >= k
        keep = np.where(enough, ONES, np.uint64(0))[:, None]
        above = np.where(keep > 0, above, inside)
        equal = equal & ~(plane ^ keep)
        found.append(enough)
    return found[::-1]


def at_least(planes: list[np.ndarray], least: list[int], valid: np.ndarray) -> np.ndarray:
    """Bitmap of the entries whose sum is at least this, by query."""
    above, equal = np.zeros_like(planes[0]), np.broadcast_to(valid, planes[0].shape)
    for i in range(len(planes) - 1, -1, -1):
        bit = np.array([ONES if (x >> i) & 1 else np.uint64(0) for x in least], np.uint64)[:, None]
        above = above | (equal & planes[i] & ~bit)
        equal = equal & ~(planes[i] ^ bit)
    return above | equal


def search_block(
    vectors: np.ndarray, slices: np.ndarray, shift: int, queries: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, the entries that can be among the k best (the exact ones and their ties), and their
    scores."""
    n = len(vectors)
    if len(queries) and n and float(abs(vectors).max()) * float(abs(queries).max()) * vectors.shape[1] >= 2.0**62:
        vectors, queries = vectors.astype(object), queries.astype(object)  # integers of any size
    valid = bitmaps(np.arange(slices.shape[2] * 64) < n)
    planes = add_slices(slices, queries)
    bits = kth_best(planes, valid, k)
    # The dropped low bits and the offset of absent dimensions shift sums by less than this.
    sums = [sum(map(abs, q)) for q in queries.tolist()]
    reach = [-(-(((1 << shift) - 1) * x) // (1 << shift)) for x in sums]
    least = [max(0, sum(1 << i for i, b in enumerate(bits) if b[q]) - reach[q]) for q in range(len(queries))]
    boundary = np.unpackbits(at_least(planes, least, valid).view(np.uint8), axis=1, bitorder="little")[:, :n]
    for q in range(len(queries)):
        entries = np.flatnonzero(boundary[q])
        score = vectors[entries] @ queries[q]
        if len(entries) > k:
            keep = score >= np.sort(score)[len(score) - k]
            entries, score = entries[keep], score[keep]
        yield q, entries, score


def ordered(score: int) -> bytes:
    """Bytes that sort like the integers they stand for, of any size."""
    size = abs(score)
    data = size.to_bytes((size.bit_length() + 7) // 8, "big")
    data = len(data).to_bytes(4, "big") + data
    return b"\x01" + data if score >= 0 else b"\x00" + bytes(255 - b for b in data)


def quantised(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and q (integers, as an array of double) of the vectors that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * scale)
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    down = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)
    return embeddings.where("vec_id is not null and embedding is not null").where(whole).select(
        "vec_id", F.transform(x, down).alias("q")
    )


def integers(a: np.ndarray) -> np.ndarray:
    """The same whole numbers as 64-bit integers, or as Python's if any is too large for a double's exact range."""
    if not a.size or np.abs(a).max() < EXACT:
        return a.astype(np.int64)
    return np.array([[int(x) for x in row] for row in a.tolist()], object)


def matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


INDEX = "block int, dims int, shift int, n int, slices binary, vectors binary, ids array<array<long>>"


def build_index(entries: DataFrame, blocks: int) -> DataFrame:
    """One row per block of entries (q, ids). Vectors of fewer dimensions are padded with zeros."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable")
        dims = max(1, int(pdf["q"].map(len).max()))
        vectors = matrix(pdf["q"], dims)
        slices, shift, _ = slice_block(integers(vectors))
        return pd.DataFrame(
            {
                "block": [int(pdf["block"].iloc[0])], "dims": [dims], "shift": [shift], "n": [len(vectors)],
                "slices": [slices.tobytes()], "vectors": [vectors.tobytes()], "ids": [[list(x) for x in pdf["ids"]]],
            }
        )

    dealt = entries.select(
        "q", "ids", F.element_at("ids", 1).alias("first"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")
    )
    return dealt.groupBy("block").applyInPandas(run, INDEX)


def top_k(embeddings: DataFrame, modulus: int = MODULUS, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose vec_id is divisible by `modulus`
    with all rows but its own; ties to smaller vec_id.

    Vectors that are null, or hold null or non-finite components (also after scaling), take no part, nor do rows without
    id. Rows that repeat a vec_id are candidates each; as a query an id counts once for each of its vectors. Products are
    exact whatever their size, and so are ranks; a score that doesn't fit a long is given as the nearest one. Shorter
    vectors are padded with zeros. An empty table gives no rows.
    """
    rows = quantised(embeddings, scale)
    nth = Window.partitionBy("q").orderBy("vec_id")
    entries = cut(
        rows.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= k + 1)
        .groupBy("q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asked = rows.where(F.col("vec_id") % modulus == 0).select("vec_id", "q", F.xxhash64("q").alias("vk"))
    vectors = cut(asked.select("vk", "q").dropDuplicates(["vk"]))
    blocks, parts = max(1, -(-entries.count() // BLOCK)), max(1, -(-vectors.count() // QUERY_BLOCK))
    index = build_index(entries, blocks)
    queries = (
        vectors.groupBy(F.pmod("vk", F.lit(parts)).alias("part"))
        .agg(F.collect_list("vk").alias("vks"), F.collect_list("q").alias("qs"))  # a block of bounded size
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            out: list[tuple] = []
            for row in batch.to_pylist():
                dims = max(row["dims"], *(len(x) for x in row["qs"]))
                data = np.zeros((row["n"], dims))
                data[:, : row["dims"]] = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])
                words = -(-row["n"] // 64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], -1, words)
                # Dimensions that no entry of the block has add nothing to a score.
                more = np.zeros((dims - row["dims"], *slices.shape[1:]), np.uint64)
                asking = integers(matrix(pd.Series(row["qs"]), dims))
                for q, found, score in search_block(integers(data), np.concatenate([slices, more]), row["shift"], asking, k + 1):
                    best = sorted(
                        (-s, i) for e, s in zip(found.tolist(), score.tolist(), strict=True) for i in row["ids"][e]
                    )[: k + 1]
                    out += [(row["vks"][q], ordered(-s), max(min(-s, LARGEST), ~LARGEST), i) for s, i in best]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["vk", "exact", "score", "vec_id"]
            )

    found = (
        queries.join(index.hint("shuffle_hash"), "block")
        .select("vks", "qs", "dims", "shift", "n", "slices", "vectors", "ids")
        .mapInArrow(run, "vk long, exact binary, score long, vec_id long")
    )
    order = (F.col("exact").desc(), F.col("vec_id"))
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("vk").orderBy(*order))).where(F.col("_n") <= k + 1)
    return (
        asked.select(F.col("vec_id").alias("query_id"), "vk").distinct()
        .join(best.drop("_n").hint("merge"), "vk")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "vk").orderBy(*order)))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id,
        CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
