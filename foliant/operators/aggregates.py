"""Grouped votes, ordered lists and counters. Order is always an explicit key, never the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import is_unknown


def known(value: str) -> Column:
    """Neither null, empty nor `unknown`, as written."""
    return F.col(value).isNotNull() & ~F.col(value).isin("", "unknown")


def consensus(df: DataFrame, key: str, value: str, order: str, fallback: str = "unknown") -> DataFrame:
    """(key, value, n_votes): the most common known value; a tie for it gives the fallback. Groups without a known value
    have the fallback too. Three grouped aggregates over one scan: unknown values are counted as null, which no known count
    is less than."""
    v = df.groupBy(key, F.when(known(value), F.col(value)).alias("v")).agg(F.count("*").alias("n"))
    top = v.groupBy(key, F.when(F.col("v").isNotNull(), F.col("n")).alias("n")).agg(F.count("*").alias("ties"), F.min("v").alias("v"))
    return top.groupBy(key).agg(F.max(F.struct("n", "ties", "v")).alias("b")).select(
        key,
        F.when((F.col("b.ties") == 1) & F.col("b.n").isNotNull(), F.col("b.v")).otherwise(F.lit(fallback)).alias(value),
        F.coalesce("b.n", F.lit(0)).alias("n_votes"),
    )


def most_common_known(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most common known value (in any spelling of unknown); of equally common ones the one seen first."""
    votes = df.where(~is_unknown(F.col(value))).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "o", "v")).alias("b")
    return votes.groupBy(key).agg(best).select(key, F.col("b.v").alias(value))


def first_non_null(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """First value in order that isn't null; an empty string counts."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def ordered_union(df: DataFrame, key: str, items: str, order: str, cap: int | None = None) -> DataFrame:
    """Distinct non-blank items of a group's arrays, in order of first appearance; at most `cap`. Items are made distinct and
    ranked before they are gathered, so with a cap no more than that many of a group are."""
    if cap:  # a row's items past its own first `cap` different ones can't be among the group's
        df = df.withColumn(items, F.slice(F.array_distinct(F.filter(items, lambda x: F.trim(x) != "")), 1, cap))
    exploded = df.select(key, F.col(order).alias("o"), F.posexplode(items).alias("p", "item")).where("trim(item) <> ''")
    first = exploded.groupBy(key, "item").agg(F.min(F.struct("o", "p")).alias("at"))
    if cap:
        place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
        first = first.withColumn("_n", place).where(F.col("_n") <= cap)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("l"))
    return lists.select(key, F.transform("l", lambda x: x["item"]).alias(items))


def first_seen(df: DataFrame, keys: Sequence[str], item: str, order: Sequence[str], into: str, most: int) -> DataFrame:
    """Distinct values of a column by key in order of first appearance, the first `most`. Values are made distinct and ranked
    before any are gathered."""
    first = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(F.struct(*order)).alias("_at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", item))
    kept = first.withColumn("_n", place).where(F.col("_n") <= most)
    lists = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", item))).alias("_l"))
    return lists.select(*keys, F.transform("_l", lambda x: x[item]).alias(into))


def counter_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of each value as a map sorted by value."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))
