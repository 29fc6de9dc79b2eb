"""Product codes of vectors, their codebooks learned by Lloyd's rounds over two trees.

Vectors become integers and are cut into parts. Blocks of some thousand vectors get one tree for each part position, with
box, count and cached sum of every node; they are built once and written out. In a round a second tree, over the entries of
the codebook, meets the first: of a pair of nodes the nearest and farthest distance of their boxes are known, so a pair that
another entry surely beats is dropped. A node left with one entry is assigned as a whole through its sum; the vectors of a
leaf left with several are assigned by exact integer distances. Tasks return sums by entry, which Spark adds up; the driver
sees one codebook.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import cut, sliced, table
from foliant.llm.graph import join_split

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one block, and of a leaf at most.
BLOCK, LEAF = 4096, 16
#: A double below this is an exact integer after rounding down. Squared distances below SAFE fit 64 bits.
EXACT, SAFE = float(1 << 53), 1 << 62
LARGEST = (1 << 63) - 1
#: Sums travel in limbs of so many bits, so that any number of them can be added.
LIMB = 40


def offsets(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin, halving until no node has more than `leaf` rows; the end is last."""
    levels = [np.array([0, n])]
    while int(np.diff(levels[-1]).max()) > leaf:
        at = levels[-1]
        split = np.empty(2 * len(at) - 1, np.int64)
        split[::2], split[1::2] = at, (at[:-1] + at[1:]) // 2
        levels.append(split)
    return levels


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tree over the rows: their order, and lowest, highest and sum of the nodes, level by level as in a heap. Each node is
    halved at the median of its widest dimension."""
    order, lows, highs, sums = np.arange(len(points)), [], [], []
    for at in offsets(len(points), leaf):
        inside = points[order]
        if len(lows):  # the level above says along which dimension its nodes are halved
            widest = (highs[-1] - lows[-1]).argmax(axis=1)
            node = np.repeat(np.arange(len(widest)), np.diff(at[::2]))
            order = order[np.lexsort((inside[np.arange(len(inside)), widest[node]], node))]
            inside = points[order]
        for out, ufunc in ((lows, np.minimum), (highs, np.maximum), (sums, np.add)):
            out.append(ufunc.reduceat(inside, at[:-1], axis=0))
    return order, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums)


class EntryTree:
    """Tree over a codebook: boxes of nodes, their children, and the entry of a leaf (-1 elsewhere)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.rows: list[tuple] = []
        self._add(np.arange(len(entries)))
        self.low, self.high, self.left, self.right, self.entry = (np.array(x) for x in zip(*self.rows, strict=True))

    def _add(self, members: np.ndarray) -> int:
        inside, at = self.entries[members], len(self.rows)
        low, high = inside.min(axis=0), inside.max(axis=0)
        self.rows.append((low, high, -1, -1, int(members[0])))
        if len(members) > 1:
            order = members[np.argsort(inside[:, (high - low).argmax()] if low.size else members, kind="stable")]
            half = len(order) // 2
            self.rows[at] = (low, high, self._add(order[:half]), self._add(order[half:]), -1)
        return at


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted keys."""
    return np.flatnonzero(np.diff(keys, prepend=-1))


def pruned(low: np.ndarray, high: np.ndarray, tree: EntryTree, data: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which pairs (data node, entry node), sorted by data node, can still hold a nearest entry."""
    gap = np.maximum(np.maximum(tree.low[entry] - high[data], low[data] - tree.high[entry]), 0)
    reach = np.maximum(tree.high[entry] - low[data], high[data] - tree.low[entry])
    near, far = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
    starts = firsts(data)
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(data)))
    keep = near <= np.minimum.reduceat(far, starts)[group]
    # Against the single entry that reaches least far, the difference of distances is linear: its largest value is at a corner.
    order = np.lexsort((far, group))
    best = tree.entry[entry[order[starts]]][group]
    mine = tree.entry[entry]
    both = np.flatnonzero(keep & (best >= 0) & (mine >= 0) & (best != mine))
    a, b = tree.entries[best[both]], tree.entries[mine[both]]
    corner = np.where(b > a, high[data[both]], low[data[both]])
    behind = ((corner - a) ** 2 - (corner - b) ** 2).sum(axis=1)
    keep[both] = ~((behind < 0) | ((behind == 0) & (best[both] < mine[both])))
    return keep


def walk(low: np.ndarray, high: np.ndarray, tree: EntryTree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both trees from their roots down: (data nodes, their one entry) and (leaves, each entry left to them)."""
    leaf_from, data, entry = len(low) // 2, np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole, open_ = [(data[:0], data[:0])], [(data[:0], data[:0])]
    while len(data):
        keep = pruned(low, high, tree, data, entry)
        data, entry = data[keep], entry[keep]
        starts = firsts(data)
        sizes = np.diff(starts, append=len(data))
        single = tree.entry[entry] >= 0
        all_single = np.repeat(np.logical_and.reduceat(single, starts), sizes)
        one = all_single & np.repeat(sizes == 1, sizes)
        whole.append((data[one], tree.entry[entry[one]]))
        leaf = all_single & ~one & (data >= leaf_from)
        open_.append((data[leaf], tree.entry[entry[leaf]]))
        more = ~one & ~leaf
        data, entry, single = data[more], entry[more], single[more]
        copies = np.where(single, 1, 2)
        data, entry, second = np.repeat(data, copies), np.repeat(entry, copies), np.zeros(int(copies.sum()), bool)
        second[np.cumsum(copies)[copies == 2] - 1] = True
        inner = tree.entry[entry] < 0
        entry = np.where(inner, np.where(second, tree.right[entry], tree.left[entry]), entry)
        deeper = data < leaf_from
        below = np.concatenate([data[~deeper], 2 * data[deeper] + 1, 2 * data[deeper] + 2])
        order = np.argsort(below, kind="stable")
        data, entry = below[order], np.concatenate([entry[~deeper], entry[deeper], entry[deeper]])[order]
    return (*map(np.concatenate, zip(*whole, strict=True)), *map(np.concatenate, zip(*open_, strict=True)))


def nearest_open(points: np.ndarray, leaf_at: np.ndarray, first: int, entries: np.ndarray, leaves: np.ndarray, left: np.ndarray) -> tuple:
    """(positions, entries) of the vectors in uncertain leaves, by exact distances; ties to the lower entry."""
    start, size = leaf_at[leaves - first], leaf_at[leaves - first + 1] - leaf_at[leaves - first]
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    entry = np.repeat(left, size)
    d = ((points[at] - entries[entry]) ** 2).sum(axis=1)
    order = np.lexsort((entry, d, at))
    order = order[firsts(at[order])]
    return at[order], entry[order]


FOREST = "ids array<long>, labels array<string>, n int, kind string, orders binary, points binary, lows binary, highs binary, sums binary"


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's where a component is too large for a double's exact range."""
    if not x.size or np.abs(x).max() * scale < EXACT:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) * scale >= EXACT else int(np.floor(v * scale)) for v in row] for row in x.tolist()], object)


def padded(values: pa.ListArray, dims: int) -> np.ndarray:
    sizes = np.diff(values.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(values), dims))
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(values)), sizes), place] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def planted(ids: list, labels: list, q: np.ndarray, parts: int) -> tuple:
    """A row of the forest. Blocks of numbers too large for 64-bit distances keep their vectors as text."""
    largest = int(abs(q).max()) if q.size else 0
    if q.dtype == object or (2 * largest) ** 2 * q.shape[1] >= SAFE:
        return ids, labels, len(q), "text", b"", json.dumps(q.tolist()).encode(), b"", b"", b""
    kind = next(k for k in ("<i2", "<i4", "<i8") if largest < 1 << (8 * int(k[2]) - 1))
    cells = q.reshape(len(q), parts, -1)
    trees = [grow(cells[:, p]) for p in range(parts)]
    pack = lambda arrays, to: b"".join(np.ascontiguousarray(a).astype(to).tobytes() for a in arrays)
    return (
        ids, labels, len(q), kind, pack([t[0] for t in trees], "<i4"), pack([cells[t[0], p] for p, t in enumerate(trees)], kind),
        pack([t[1] for t in trees], kind), pack([t[2] for t in trees], kind), pack([t[3] for t in trees], "<i8"),
    )


def forest(kept: DataFrame, dims: int, parts: int, scale: int) -> DataFrame:
    """Rows (vec_id, label, embedding) in blocks, as their tasks read them, with a tree for each part position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []

        def row() -> pa.RecordBatch:
            out = planted(ids, labels, whole_numbers(np.concatenate(held), scale), parts)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], names=names)

        for batch in sliced(batches, BLOCK // 4):
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            held.append(padded(batch.column(2), dims))
            if len(ids) >= BLOCK:
                yield row()
                ids, labels, held = [], [], []
        if ids:
            yield row()

    names = [x.strip().split(" ")[0] for x in FOREST.split(", ")]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.string(), *[pa.binary()] * 5]
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, FOREST)


class Books:
    """Codebooks of all part positions, with a tree each where their numbers allow 64-bit distances."""

    def __init__(self, entries: list[list[list[int]]]) -> None:
        self.wide = [np.array(e, object).reshape(len(e), -1) for e in entries]
        self.largest = max((abs(x) for e in entries for row in e for x in row), default=0)
        self.trees = [EntryTree(e.astype(np.int64)) for e in self.wide] if self.largest < 1 << 30 else []

    def assign(self, row: dict) -> Iterator[tuple]:
        """For each part position: the vectors' entries, and count and sum by entry; then the vectors themselves."""
        n, parts = row["n"], len(self.wide)
        width = self.wide[0].shape[1]
        if row["kind"] == "text":
            cells = np.array(json.loads(row["points"]), object).reshape(n, parts, width)
            yield from (self._plain(cells[:, p], p, np.arange(n)) for p in range(parts))
            return
        read = lambda name, to, *shape: np.frombuffer(row[name], to).reshape(parts, *shape).astype(np.int64)
        orders, points = read("orders", "<i4", n), read("points", row["kind"], n, width)
        safe = self.trees and (int(abs(points).max(initial=0)) + self.largest) ** 2 * max(1, width) < SAFE
        if not safe:
            yield from (self._plain(points[p].astype(object), p, orders[p]) for p in range(parts))
            return
        levels = offsets(n, LEAF)
        starts, ends = np.concatenate([x[:-1] for x in levels]), np.concatenate([x[1:] for x in levels])
        shape = (len(starts), width)
        lows, highs, sums = read("lows", row["kind"], *shape), read("highs", row["kind"], *shape), read("sums", "<i8", *shape)
        for p, tree in enumerate(self.trees):
            k = len(tree.entries)
            nodes, one, leaves, left = walk(lows[p], highs[p], tree)
            at, entry = nearest_open(points[p], levels[-1], len(starts) // 2, tree.entries, leaves, left)
            size = ends[nodes] - starts[nodes]
            counts, total = np.bincount(entry, minlength=k), np.zeros((k, width), np.int64)
            np.add.at(counts, one, size)
            np.add.at(total, one, sums[p][nodes])
            np.add.at(total, entry, points[p][at])
            labels = np.empty(n, np.int64)
            labels[np.repeat(starts[nodes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.repeat(one, size)
            labels[at] = entry
            yield labels, counts, total, points[p], orders[p]

    def _plain(self, x: np.ndarray, p: int, order: np.ndarray) -> tuple:
        entries = self.wide[p]
        d = np.zeros((len(x), len(entries)), object)
        for e in range(len(entries)):
            d[:, e] = ((x - entries[e]) ** 2).sum(axis=1) if x.shape[1] else 0
        labels = d.argmin(axis=1).astype(np.int64)
        total = np.zeros(entries.shape, object)
        for e in range(len(entries)):
            total[e] = x[labels == e].sum(axis=0)
        return labels, np.bincount(labels, minlength=len(entries)), total, x, order


def limbs(x: int) -> list[int]:
    """The number in pieces of LIMB bits, lowest first; only the last has a sign."""
    out = []
    while not -(1 << LIMB) <= x < 1 << LIMB:
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


def next_books(trees: DataFrame, now: list[list[list[int]]]) -> list[list[list[int]]]:
    """One round: the sums of all parts by their nearest entry, divided; entries that no part is nearest to stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, width = Books(now), len(now[0][0])
        total = np.zeros((len(now), len(now[0]), width + 1), object)
        for batch in sliced(batches, 8):
            for row in batch.to_pylist():
                for p, (_, counts, sums, _, _) in enumerate(books.assign(row)):
                    total[p, :, 0] += counts
                    total[p, :, 1:] += sums
        out = [
            (p, e, i, j, limb)
            for p in range(len(now)) for e in range(len(now[0])) if total[p, e, 0]
            for i in range(width + 1) for j, limb in enumerate(limbs(int(total[p, e, i])))
        ]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (*[pa.int32()] * 4, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "place", "limb", "value"])

    needed = trees.select("n", "kind", "orders", "points", "lows", "highs", "sums")
    sums = needed.mapInArrow(run, "part int, entry int, place int, limb int, value long")
    found: dict[tuple, int] = {}
    for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():  # one codebook's numbers
        key = (r["part"], r["entry"], r["place"])
        found[key] = found.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
    return [
        [[found[p, e, i + 1] // found[p, e, 0] for i in range(len(entry))] if (p, e, 0) in found else entry for e, entry in enumerate(book)]
        for p, book in enumerate(now)
    ]


def coded(trees: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """vec_id, label, code and error of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Books(books)
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            codes, errors = np.empty((row["n"], len(books)), np.uint8), np.zeros(row["n"], object)
            for p, (labels, _, _, points, order) in enumerate(found.assign(row)):
                codes[order, p] = labels
                entries = found.wide[p] if points.dtype == object else found.wide[p].astype(np.int64)
                errors[order] += ((points - entries[labels]) ** 2).sum(axis=1)
            text = codes.tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(row["labels"], pa.string()),
                    pa.array([text[i * step : (i + 1) * step] for i in range(row["n"])], pa.string()),
                    pa.array([min(int(e), LARGEST) for e in errors], pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return trees.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of (vec_id, embedding, label) that takes part.

    Vectors that are null or hold null or non-finite components take no part; without any there are no rows. A row without
    id takes part and comes last among the starting entries; rows that repeat an id are one vector each, in the order of
    their vectors. Fewer rows than entries give as many entries as there are rows. Shorter vectors are padded with zeros to
    the longest one's length, and that to a multiple of `parts`. Numbers of any size are exact; an error that doesn't fit a
    long is given as the largest long. Other columns are not looked at."""
    spark = embeddings.sparkSession
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = embeddings.where(F.col("embedding").isNotNull()).where(~odd).select(
        "vec_id", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if longest is None:
        return spark.createDataFrame([], schema)
    dims = -(-longest // parts) * parts
    starts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    first = np.zeros((len(starts), dims))
    for i, r in enumerate(starts):
        first[i, : len(r[0])] = r[0]
    cells = whole_numbers(first, scale).reshape(len(starts), parts, -1)
    books = [[[int(x) for x in entry] for entry in cells[:, p]] for p in range(parts)]
    trees = cut(forest(kept, dims, parts, scale))
    for _ in range(rounds):
        books = next_books(trees, books)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    rows = cut(coded(trees, books))
    totals = rows.groupBy("label").agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"),
        F.count("*").alias("_rows"),
    )
    return join_split(rows, totals, "label", "_rows", rows.count(), nulls=False).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """One assignment and update in long form: parts p (r, part, j, c), entries (part, e, j, k)."""
    return f"""
d{i} AS MATERIALIZED (
    SELECT r, part, min(d * 16 + e) AS m
    FROM (SELECT r, part, e, sum((c - k) * (c - k)) AS d FROM p JOIN b{i} USING (part, j) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (
    SELECT part, e, j, CAST(coalesce((s - ((s % n) + n) % n) // n, k) AS BIGINT) AS k
    FROM b{i} LEFT JOIN (
        SELECT part, m % 16 AS e, j, sum(c) AS s, count(*) AS n FROM d{i} JOIN p USING (r, part) GROUP BY ALL) USING (part, e, j)),"""


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r,
        list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
    SELECT r, (i - 1) // (len(q) // 8) AS part, (i - 1) % (len(q) // 8) AS j, q[i] AS c
    FROM (SELECT r, q, unnest(range(1, len(q) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, j, c AS k FROM p WHERE r <= 16),
{"".join(_round(i) for i in range(ROUNDS))}
f AS (
    SELECT r, part, min(d * 16 + e) AS m
    FROM (SELECT r, part, e, sum((c - k) * (c - k)) AS d FROM p JOIN b{ROUNDS} USING (part, j) GROUP BY ALL) GROUP BY ALL),
g AS (
    SELECT r, string_agg('0' || substr('0123456789abcdef', CAST(m % 16 AS INTEGER) + 1, 1), '' ORDER BY part) AS code,
        CAST(sum(m // 16) AS BIGINT) AS error
    FROM f GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    sha256((SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY part, e, j) FROM b{ROUNDS})) AS codebooks_sha256
FROM v JOIN g USING (r)
"""
