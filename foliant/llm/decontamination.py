"""Benchmark decontamination: prefix-filtered set join of documents with item windows.

A window is ten consecutive words of an item; it occurs only if all its words do, in place. So one necessary prefix
token a window is enough: its rarest word, by counts over all documents. Documents are read past an index of these
words; a hit fixes where the window would lie, length and position bounds drop what would not fit, and the words there
are compared exactly. The index is sent to the tasks in blocks of bounded size, as many as the benchmark needs.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import WORD_BYTES, forget, fresh, sliced, stored, table

WINDOW = 10
#: Item words in one block of the index; a larger benchmark makes more passes over the documents.
BLOCK_WORDS = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of digits, a-z and everything outside ASCII."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All windows of an item; a shorter item that has words is one window."""
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Items (id, words) in blocks of bounded size, one at a time, read by Spark."""
    size = F.coalesce(F.length("text"), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // (2 * block_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r["item_id"], words_of(r["text"])) for r in items.where(part == i).select("item_id", "text").collect()]


class PrefixIndex:
    """Windows by their rarest word: word -> [(place in the window, window, items)]."""

    def __init__(self, items: list[tuple], counts: dict[bytes, int], width: int) -> None:
        of: dict[tuple, set] = defaultdict(set)
        for item, words in items:
            for window in windows_of(words, width):
                of[window].add(item)
        self.by_word: dict[bytes, list] = defaultdict(list)
        for window, ids in of.items():
            rare = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
            self.by_word[window[rare]].append((rare, window, tuple(ids)))
        self.by_word = dict(self.by_word)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words that are hit, and the items with a window there."""
        spans, items, n, by_word = [], set(), len(words), self.by_word
        for i in [i for i, w in enumerate(words) if w in by_word]:
            for place, window, ids in by_word[words[i]]:
                start, end = i - place, i - place + len(window)
                if start >= 0 and end <= n and tuple(words[start:end]) == window:
                    spans.append((start, end))
                    items.update(ids)
        return spans, items


def word_counts(documents: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often the words of one index block occur in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        known = shared.value
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts.update([w for w in words_of(text) if w in known])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"]
        )

    got = documents.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in got}


def with_hits(
    documents: DataFrame, items: DataFrame, names: list[str], width: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """All columns of documents, and under the three names the number of words, hit spans (starts and ends in turn) and ids
    of occurring items. Items without words take no part; those without an id count as one item of no name. A null text
    has no words. What a block of items adds is written before the next one, so a task holds one block's index."""
    n_words, spans_of, items_of = names
    columns, at = documents.columns, documents.columns.index("text")
    out = documents.withColumns({spans_of: F.array().cast("array<long>"), items_of: F.array().cast("array<string>")})
    schema = T.StructType(
        [
            *documents.schema.fields,
            T.StructField(n_words, T.LongType()),
            T.StructField(spans_of, T.ArrayType(T.LongType())),
            T.StructField(items_of, T.ArrayType(T.StringType())),
        ]
    )
    before = None
    for i, block in enumerate(item_blocks(items, block_words)):
        if i:
            out, path = stored(out)
            if before:
                forget(documents.sparkSession, before)
            before = path
        vocabulary = {w for _, words in block for w in words}
        index = documents.sparkSession.sparkContext.broadcast(
            PrefixIndex(block, word_counts(documents, vocabulary) if vocabulary else {}, width)
        )

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                n, spans, ids = [], batch.column(spans_of).to_pylist(), batch.column(items_of).to_pylist()
                for i, text in enumerate(batch.column(at).to_pylist()):
                    words = words_of(text)
                    found, hit = index.value.find(words)
                    n.append(len(words))
                    if hit:
                        spans[i] = [*spans[i], *(x for span in merged(found) for x in span)]
                        ids[i] = [*ids[i], *(None if x is None else str(x) for x in hit)]
                added = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]
                kinds = [pa.field(c, x.type) for c, x in zip(names, added, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(columns))), *added],
                    schema=pa.schema([*(batch.schema.field(i) for i in range(len(columns))), *kinds]),
                )

        out = out.select(*columns, spans_of, items_of).mapInArrow(run, schema)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


NAMES = ["_n_words", "_spans", "_items"]


def digest_hits(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hit, n, sha = [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                hit.append(sum(b - a for a, b in merged(list(zip(spans[::2], spans[1::2], strict=True)))))
                n.append(len(set(items)))
                ids = sorted(x for x in set(items) if x is not None)
                sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array(hit, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array([x > 0 for x in hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.select("doc_id", *NAMES).mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def decontaminate(documents: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per row of documents: how many words lie in occurrences of item windows, and of which items. Repeated
    rows are judged once each; without items nothing is hit."""
    return digest_hits(with_hits(documents.select("doc_id", "text"), items, NAMES, width))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed patterns of the contract, in DuckDB's dialect. The item windows are matched as joined words.
ORACLE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
hits AS (
    SELECT r, i, p.k, item_id
    FROM (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS t
          FROM places, (SELECT DISTINCT k FROM windows) WHERE i + k - 1 <= len(w)) p
    JOIN windows v ON v.t = p.t AND v.k = p.k),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r),
found AS (
    SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window, with their own columns."""
    names = fresh(docs, *NAMES)
    found = with_hits(docs, table(spark, sf_dir, "benchmark"), names)
    return found.where(F.size(names[2]) == 0).select(*docs.columns)
