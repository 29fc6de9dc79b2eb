"""Connected components of an edge table, by alternating large and small stars, and joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import forget, stored

#: Rounds after which something is wrong; the number needed grows with the logarithm of the graph.
MOST_ROUNDS = 60
#: A key of more rows than LEAST_HOT is hot, if no more than about MOST_HOT keys are: of n rows fewer than MOST_HOT keys
#: can have more than n / MOST_HOT each, so what is sent to all tasks is bounded however the rows are dealt.
LEAST_HOT, MOST_HOT = 256, 200_000
#: Edges in one file of a round's table.
ROWS_A_FILE = 100_000


def hot_size(rows: int) -> int:
    return max(LEAST_HOT, rows // MOST_HOT + 1)


def join_split(rows: DataFrame, side: DataFrame, key: str, count: str, total: int, nulls: bool = True) -> DataFrame:
    """Left join of rows with `side`, which has one row per key and says in `count` how many rows have it. Hot keys go to
    all tasks, so their rows stay where they are; the others are shuffled, and null keys neither (`nulls`: whether there
    may be some). `count` is left out."""
    values = [c for c in side.columns if c not in (key, count)]
    value, hot = F.struct(*values), F.col(count) > hot_size(total)
    met = (rows.where(F.col(key).isNotNull()) if nulls else rows).join(F.broadcast(side.where(hot).select(key, value.alias("_hot"))), key, "left")
    far = met.where("_hot is not null").select(*rows.columns, "_hot.*")
    cold = side.where(~hot).select(key, value.alias("_cold"))
    near = met.where("_hot is null").drop("_hot").join(cold.hint("merge"), key, "left").select(*rows.columns, "_cold.*")
    if not nulls:
        return far.unionByName(near)
    kinds = {f.name: f.dataType for f in side.schema.fields}
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(kinds[c]).alias(c) for c in values))
    return far.unionByName(near).unionByName(none)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the smallest node of its component. Each round is two grouped
    minima and two joins; a node with many neighbours is joined where its edges are. Each round is written to the shared
    folder and the one before removed. No edges give no rows."""
    spark = edges.sparkSession
    now, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = fingerprint(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        files = state[0] // ROWS_A_FILE + 1  # a round of few edges is few tasks, however many partitions shuffles have
        large, between = stored(large_star(now, state[0]).coalesce(files))
        small, new = stored(small_star(large, state[0]).coalesce(files))  # a star has no more edges than it is made of
        forget(spark, path)
        forget(spark, between)
        now, path, before, state = small, new, state, fingerprint(small)
        if state == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Joins each larger neighbour of a node to the node's smallest neighbour. Edges are (larger, smaller)."""
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = edges.union(larger).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    met = join_split(larger, least.where("n > 0"), "a", "n", total, nulls=False)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Joins each smaller neighbour of a node, and the node, to its smallest neighbour. Edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_split(edges, least, "a", "n", total, nulls=False).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
