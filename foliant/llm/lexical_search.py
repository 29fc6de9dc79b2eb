"""Ranked lexical search: item weights times document impacts, as blocked products of dense matrices.

Documents are read once: each becomes its length and its counts of terms that items have, and each task adds one row of
statistics. Weights follow from these. Then tiles of documents meet tiles of items. An item tile has its own compact
vocabulary, cut into columns so that no partial sum of whole numbers reaches 2^53; there products in float64 are exact. They are
added up as 64-bit integers, and each task keeps the best rows of an item, ties by document, from tile to tile.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import CHUNK, WORD_BYTES, cut, sliced, strings, table

K = 20
#: Item words that are searched for in one pass; more items make more passes.
GROUP_WORDS = 200_000
#: Items, documents and terms of a tile.
ITEMS, DOCUMENTS, COLUMNS = 64, 1024, 2048
#: An impact is below this, so weights of a tile that add up to less than MOST_WEIGHT give sums below 2^53.
MOST_IMPACT = 10**6
MOST_WEIGHT = (1 << 53) // MOST_IMPACT
#: Partial results of tasks are merged in so many groups before they meet by item.
MERGES = 64
LAST = (1 << 63) - 1


def term_counts(text: str, known: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of terms of a whole text, and how often it has the known ones. A long text is split in stretches."""
    spaced, n, at, found = text.encode("utf-8", "replace").translate(WORD_BYTES), 0, 0, Counter()
    while at < len(spaced):
        end = spaced.find(b" ", at + CHUNK)
        end = len(spaced) if end < 0 else end
        terms = spaced[at:end].split()
        n += len(terms)
        found.update(map(known.get, terms))
        at = end
    found.pop(None, None)
    return n, found


def item_groups(items: DataFrame, words: int) -> Iterator[list[tuple]]:
    """Different items (id, text) in groups of bounded size, one at a time."""
    rows = items.where("length(text) > 0").select(F.col("item_id").cast("long"), "text").distinct()
    n = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // (2 * words)))
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


COUNTS = "doc_id long, n long, terms array<int>, counts array<long>, docs long, words long"


def counted(documents: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """A row for each document that has known terms, and for each task one with `docs` and `words` that says how many
    documents and words it saw, and how many documents have each term."""
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def batch_of(ids: list, ns: list, found: list[Counter], docs: list, words: list) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        terms = pa.ListArray.from_arrays(ends, pa.array([t for x in found for t in x], pa.int32()))
        counts = pa.ListArray.from_arrays(ends, pa.array([c for x in found for c in x.values()], pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), terms, counts, pa.array(docs, pa.int64()), pa.array(words, pa.int64())],
            names=["doc_id", "n", "terms", "counts", "docs", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, docs, words, holding = shared.value, 0, 0, Counter()
        for batch in sliced(batches):
            ids, ns, found = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                n, counts = term_counts(text, terms)
                docs, words = docs + (n > 0), words + n
                if counts:
                    holding.update(counts.keys())
                    ids.append(doc_id)
                    ns.append(n)
                    found.append(counts)
            none = [None] * len(ids)
            yield batch_of(ids, ns, found, none, none)
        yield batch_of([None], [None], [holding], [docs], [words])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COUNTS)


def columns(weights: list[dict[int, int]], most: int = MOST_WEIGHT, width: int = COLUMNS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights of items by term) of an item tile, in pieces of at most `width` terms in which no item's weights add
    up to more than `most`. A larger weight is spread over several pieces."""
    out: list[tuple] = []
    terms: list[int] = []
    cells: list[dict[int, int]] = []
    sums: Counter = Counter()

    def close() -> None:
        if terms:
            w = np.zeros((len(weights), len(terms)))
            for j, column in enumerate(cells):
                for i, x in column.items():
                    w[i, j] = x
            out.append((np.array(terms, np.int64), w))
        terms.clear()
        cells.clear()
        sums.clear()

    holders: dict[int, dict[int, int]] = {}
    for i, of in enumerate(weights):
        for t, w in of.items():
            holders.setdefault(t, {})[i] = w
    for t in sorted(holders):
        left = {i: w for i, w in holders[t].items() if w}
        while left:
            now = {i: min(w, most) for i, w in left.items()}
            if len(terms) == width or any(sums[i] + w > most for i, w in now.items()):
                close()
            terms.append(t)
            cells.append(now)
            sums.update(now)
            left = {i: w - now[i] for i, w in left.items() if w > now[i]}
    close()
    return out


class Best:
    """The k best (score, document) of each item of a tile so far; ties to the smaller id, documents without id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.rows = k, [[] for _ in range(items)]
        self.least, self.last = np.zeros(items, np.int64), np.zeros(items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        least, last = self.least[:, None], self.last[:, None]
        may = (scores > least) | ((scores == least) & (scores > 0) & (ids < last))
        for i in np.flatnonzero(may.any(axis=1)):
            at = np.flatnonzero(may[i])
            at = at[np.lexsort((absent[at], ids[at], -scores[i, at]))[: self.k]]
            more = zip((-scores[i, at]).tolist(), ids[at].tolist(), absent[at].tolist(), strict=True)
            self.rows[i] = sorted([*self.rows[i], *more])[: self.k]
            if len(self.rows[i]) == self.k:
                self.least[i], self.last[i] = -self.rows[i][-1][0], self.rows[i][-1][1]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Impact of terms that occur tf times in documents of n terms, in whole numbers."""
    m = 100 - 25 + (25 * n * docs) // words
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def scored(rows: DataFrame, tiles: list[list[dict[int, int]]], vocabulary: int, docs: int, words: int, k: int) -> DataFrame:
    """item (number in the group), score, doc_id: each task's best."""
    shared = rows.sparkSession.sparkContext.broadcast(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = []
        for tile in shared.value:
            pieces = []
            for terms, w in columns(tile):
                place = np.full(vocabulary, -1, np.int32)
                place[terms] = np.arange(len(terms))
                pieces.append((place, w))
            work.append((pieces, Best(len(tile), k)))
        for batch in sliced(batches, DOCUMENTS):
            lists, n = batch.column(2), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            row = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            terms, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            impact = impacts(tf, n[row], docs, words).astype(np.float64)
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(LAST).to_numpy()
            for pieces, best in work:
                scores = np.zeros((len(best.rows), len(n)), np.int64)
                for place, w in pieces:
                    at = place[terms]
                    has = np.flatnonzero(at >= 0)
                    if len(has):
                        x = np.zeros((w.shape[1], len(n)))
                        x[at[has], row[has]] = impact[has]
                        scores += (w @ x).astype(np.int64)
                best.add(scores, ids, absent)
        out = [
            (t * ITEMS + i, -s, None if absent else d)
            for t, (_, best) in enumerate(work) for i, found in enumerate(best.rows) for s, d, absent in found
        ]
        cells = list(zip(*out, strict=True)) or [[]] * 3
        kinds = (pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cells, kinds, strict=True)], names=["item", "score", "doc_id"])

    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, score long, doc_id long")


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def search(documents: DataFrame, items: DataFrame, k: int = K, group_words: int = GROUP_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, from 1; equal scores by
    ascending doc_id, documents without id last.

    A null text has no terms. Rows of documents that repeat an id or a text are documents each; rows of items that repeat
    both count once, and items that share an id are ranked each by itself. Items without terms, empty tables, and documents
    without any term of an item give no rows. Other columns are not looked at; texts of any length are read whole."""
    spark, found = documents.sparkSession, []
    for g, group in enumerate(item_groups(items, group_words)):
        group = sorted(group, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        wanted = [Counter(text.encode("utf-8", "replace").translate(WORD_BYTES).split()) for _, text in group]
        known = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
        if not known:
            continue
        rows = cut(counted(documents, known))
        stats = rows.where("docs is not null")
        docs, words = stats.agg(F.sum("docs"), F.sum("words")).first()
        if not words:
            break
        holding = stats.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
        weights = {r["terms"]: weight(docs, r["n"]) for r in holding.collect()}  # no more than the group has words
        lists = [{known[t]: c * weights.get(known[t], 0) for t, c in of.items()} for of in wanted]
        tiles = [lists[i : i + ITEMS] for i in range(0, len(lists), ITEMS)]
        best = scored(rows.where("docs is null"), tiles, len(known), docs, words, k)
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(group)], "item long, item_id long")
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("merge", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
        for keys in (("item", "merge"), ("item",)):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        # names has a row an item of the group, of which there are no more than GROUP_WORDS with terms
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed patterns of the contract, in DuckDB's dialect.
ORACLE_SQL = r"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS MATERIALIZED (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM docs),
tf AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY ALL),
weights AS (
    SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * n + 1))) AS BIGINT) AS weight
    FROM (SELECT t, CAST(count(*) AS DOUBLE) AS n FROM tf GROUP BY t), s),
scores AS (
    SELECT i, item_id, d.r, doc_id,
        CAST(sum(n * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(d.w) * docs) // words)))) AS BIGINT) AS score
    FROM (SELECT i, item_id, t, count(*) AS n FROM (SELECT i, item_id, unnest(w) AS t FROM items) GROUP BY ALL) q
    JOIN weights USING (t) JOIN tf USING (t) JOIN docs d USING (r), s
    GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
