"""N-gram Jaccard join of documents: MinHash bands find candidates, full sets of five-word shingles verify them.

Texts with equal shingle sets are one class, so copies never meet as pairs. Classes that share a band are joined to the
band's smallest class, which gives candidate groups without listing pairs. Bands of unlike texts meet by chance and chain
such groups together, so a group of more than a block of classes is first taken apart: within each band's own bucket
MinHash signatures are compared, and only classes whose estimated similarity is not far below the wanted one stay linked.
The sets of a group are shuffled once, to a grid of bounded blocks; each cell of the grid verifies all its pairs exactly
and returns a forest of links and the number of linked documents, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import (
    BASE,
    binary_words,
    cut,
    fresh,
    mix,
    multipliers,
    segments,
    shingle_hashes,
    sliced,
    strings,
    table,
    word_hashes,
)
from foliant.llm.graph import components, join_split

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.9995
#: A block of a group holds about so many sets, and so many shingles.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000
#: How far below the wanted similarity the estimate of a linked pair may lie: five standard deviations of 100 hashes.
SLACK = 0.2
#: Smallest id in front of a node's name, so that the smallest node of a component has the smallest document; ids that are
#: null come last.
SIGN, NO_ID = -(1 << 63), "g" * 16


def choose_bands(similarity: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """Bands and rows a band: as many bands as give `recall` at exactly this similarity."""
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
    return bands, rows


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    h, n = word_hashes([binary_words(x) for x in texts])
    return shingle_hashes(h, n, width)


def set_key(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def band_keys(shingles: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each band of each set (sets by bands), and a byte of each MinHash (sets by bands times rows); sets must not
    be empty."""
    at = segments(counts)
    out = np.empty((len(counts), bands), np.int64)
    signature = np.empty((len(counts), bands * rows), np.uint8)
    a = multipliers(bands * rows)
    for band in range(bands):
        key = np.full(len(counts), band + 1, np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(shingles * a[band * rows + row] ^ (shingles >> np.uint64(29)), at)
            key = key * np.uint64(BASE) + least
            signature[:, band * rows + row] = mix(least) & np.uint64(255)
        out[:, band] = mix(key).view(np.int64)
    return out, signature


def text_key(text: Column) -> Column:
    """Names a text; null is the empty text."""
    return F.md5(F.coalesce(text, F.lit("")))


def sketches(documents: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, set_key, n_shingles, band keys and signature of every row; no key and no bands for a text without
    words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            shingles, counts = shingle_sets(strings(batch.column(2)), width)
            starts = segments(counts)
            sets = [np.unique(shingles[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
            some = np.flatnonzero(counts)
            keys: list = [None] * len(counts)
            found: list = [None] * len(counts)
            bytes_of: list = [None] * len(counts)
            if len(some):
                got, signature = band_keys(shingles, counts[some], bands, rows)
                for i, k, x in zip(some.tolist(), got.tolist(), signature, strict=True):
                    keys[i], found[i], bytes_of[i] = set_key(sets[i]), k, x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array(keys, pa.string()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array(bytes_of, pa.binary()),
                ],
                names=["doc_id", "text_key", "set_key", "n_shingles", "bands", "signature"],
            )

    return documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key string, set_key string, n_shingles long, bands array<long>, signature binary"
    )


def sets_of(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and sorted shingles (binary) of the wanted rows (node, doc_id, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            shingles, counts = shingle_sets(strings(batch.column(1)), width)
            sets = [np.unique(shingles[a : a + n]).tobytes() for a, n in zip(segments(counts).tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    # Texts without an id are made distinct where they are, as nothing else tells their rows apart.
    bare = rows.where("doc_id is null").groupBy("text_key").agg(F.first("text").alias("text"))
    rows = rows.where("doc_id is not null").unionByName(bare.withColumn("doc_id", F.lit(None).cast("long")))
    wanted = wanted.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    same = rows["doc_id"].eqNullSafe(wanted["_id"]) & (rows["text_key"] == wanted["_key"])
    return (
        rows.join(wanted.hint("shuffle_hash"), same).select("node", "text")
        .mapInArrow(run, "node string, shingles binary").dropDuplicates(["node"])
    )


def similar(sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """Boolean matrix of the pairs of sets whose Jaccard similarity is at least this; not of a set with itself."""
    sizes = np.array([len(x) for x in sets])
    tokens, where = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, of, often = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    use = shared[of]
    column, row = place[of[use]], where[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part @ part.T
    p, q = similarity.numerator, similarity.denominator
    out = (p + q) * common.astype(np.int64) >= p * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean matrix."""
    left = np.ones(len(links), bool)
    edges = []
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(links[at] & left)
            left[new] = False
            edges += [(at, x) for x in new.tolist()]
            stack += new.tolist()
    return edges


def likely(signatures: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix of the pairs whose share of equal signature bytes is at least this; not of a row with itself."""
    same = np.zeros((len(signatures), len(signatures)), np.uint16)
    for column in signatures.T:
        same += column[:, None] == column[None, :]
    out = same >= least * signatures.shape[1]
    np.fill_diagonal(out, False)
    return out


def in_cells(members: DataFrame, key: str, size: Column, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, total: int) -> DataFrame:
    """Runs `run` over all members of each key, or if they are more than a block over each pair of its blocks; members
    have a column node, `size` is how much of a block a key's members take."""
    blocks = members.groupBy(key).agg(F.ceil(size).cast("int").alias("_blocks")).where("_blocks > 1")
    # Keys of several blocks are at most so many; what is sent to all tasks is bounded by hot_size.
    blocks = F.broadcast(blocks) if blocks.count() <= 1_000_000 else blocks.hint("shuffle_hash")
    numbered = members.join(blocks, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    )
    cells = numbered.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *members.columns, "block", F.least("block", "_other").alias("x"), F.greatest("block", "_other").alias("y")
    )
    # Cells take much work for few bytes, so their number of tasks is not left to the size of the shuffle.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(tasks, key, "x", "y").groupBy(key, "x", "y").applyInPandas(run, schema)


def across(links: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
    """Links of a cell; a cell of two blocks leaves those inside one block to the cell of that block."""
    block = pdf["block"].to_numpy()
    return links if pdf["x"].iloc[0] == pdf["y"].iloc[0] else links & (block[:, None] != block[None, :])


def verify_groups(members: DataFrame, similarity: float, total: int) -> DataFrame:
    """(a, b, linked) of members (grp, node, copies, n_shingles, shingles): with b, an edge of a verified forest; without, so
    many documents are linked to class a in one cell of the group's grid."""
    least = Fraction(str(similarity))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        keys, copies = pdf["node"].tolist(), pdf["copies"].to_numpy(np.int64)
        links = across(similar(sets, least), pdf)
        rows = [(keys[i], keys[j], 0) for i, j in forest(links)]
        rows += [(keys[i], None, int(n)) for i, n in enumerate(links @ copies) if n]
        return pd.DataFrame(rows, columns=["a", "b", "linked"])

    size = F.greatest(F.count("*") / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)
    return in_cells(members, "grp", size, run, "a string, b string, linked long", total)


def likely_edges(members: DataFrame, similarity: float, total: int) -> DataFrame:
    """(a, b) of members (band, node, signature): a forest, within each band's bucket, of the pairs whose estimated
    similarity is at most SLACK below this."""
    least = similarity - SLACK

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["node"].tolist()
        links = across(likely(np.stack([np.frombuffer(x, np.uint8) for x in pdf["signature"]]), least), pdf)
        return pd.DataFrame([(keys[i], keys[j]) for i, j in forest(links)], columns=["a", "b"])

    return in_cells(members, "band", F.count("*") / (2 * BLOCK_SETS), run, "a string, b string", total)


def candidate_groups(classes: DataFrame, similarity: float, total: int) -> DataFrame:
    """(node, grp): classes that share bands, directly or through others."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = join_split(banded, shared, "band", "n", total, nulls=False).where("node <> b").select(F.col("node").alias("a"), "b")
    groups = cut(components(stars).select("node", F.col("root").alias("grp")))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    if not sizes.where(F.col("n") > BLOCK_SETS).limit(1).count():
        return groups
    sized = cut(join_split(groups, sizes.select("grp", "n", F.col("n").alias("size")), "grp", "n", total, nulls=False))
    chained = classes.join(sized.where(F.col("size") > BLOCK_SETS).select("node").hint("shuffle_hash"), "node").select("node", "signature", F.explode("bands").alias("band"))
    apart = components(likely_edges(chained, similarity, total)).select("node", F.col("root").alias("grp"))
    return sized.where(F.col("size") <= BLOCK_SETS).select("node", "grp").unionByName(apart)


def node_of(doc_id: Column, key: Column) -> Column:
    number = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(SIGN))), 16, "0")
    return F.concat(F.coalesce(number, F.lit(NO_ID)), key)


def id_of(node: Column) -> Column:
    """The id in a node's name; null if it has none."""
    number = F.left(node, F.lit(16))
    return F.when(number != NO_ID, F.conv(number, 16, -10).cast("long").bitwiseXOR(F.lit(SIGN)))


def joined_classes(documents: DataFrame, similarity: float, width: int, recall: float) -> tuple[DataFrame, DataFrame, int]:
    """Sketched rows, and the classes of equal sets: set_key, copies, node, doc_id and text_key (its first row), root
    (node of the class that all joined to it share), linked (documents of other sets linked to it); number of rows."""
    bands, rows = choose_bands(similarity, recall)
    rows_of = cut(sketches(documents, width, bands, rows))
    total = rows_of.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    classes = rows_of.where("set_key is not null").groupBy("set_key").agg(
        first.alias("r"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"),
        F.any_value("signature").alias("signature"), F.any_value("n_shingles").alias("n_shingles"),
    )
    classes = cut(
        classes.select(
            "set_key", "copies", "bands", "signature", "n_shingles", "r.doc_id", "r.text_key",
            node_of(F.col("r.doc_id"), F.col("set_key")).alias("node"),
        )
    )
    groups = candidate_groups(classes, similarity, total)
    wanted = cut(classes.drop("bands", "signature", "set_key").join(groups.hint("shuffle_hash"), "node"))
    sets = sets_of(documents, wanted, width)
    members = wanted.select("node", "grp", "copies", "n_shingles").join(sets.hint("shuffle_hash"), "node")
    verified = cut(verify_groups(members, similarity, total))
    linked = verified.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    roots = components(verified.where("b is not null").select("a", "b"))
    joined = (
        classes.drop("bands", "signature", "n_shingles").join(roots.hint("shuffle_hash"), "node", "left")
        .join(linked.hint("shuffle_hash"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    return rows_of, cut(joined), total


def ngram_jaccard_join(
    documents: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL
) -> DataFrame:
    """One row per row of documents: doc_id, class_id (smallest doc_id of all texts joined to it by links), n_links (other
    rows whose shingle sets have at least this similarity to its own).

    Candidates are found with probability `recall` at exactly `similarity`, more above it; groups of candidates are
    verified exactly. A text shorter than `width` words is one shingle; a text without words (null: empty) is a class of
    its own. Copies and repeated rows count as links of each other, and so do rows that share an id and differ in text. A
    null doc_id counts as a link but names no class. Other columns are ignored; an empty table gives no rows.
    """
    rows_of, classes, total = joined_classes(documents, similarity, width, recall)
    links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    info = classes.select("set_key", "copies", id_of(F.col("root")).alias("class_id"), links.alias("n_links"))
    return join_split(rows_of.select("doc_id", "set_key"), info, "set_key", "copies", total).select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, that of its smallest id (ids that are null last), with its own columns.

    Rows are told apart by id and text: of rows that share both one stays; rows that share an id only are judged each by
    its text. A text without words is a class of its own, so such rows stay, one of each id."""
    rows_of, classes, total = joined_classes(docs, SIMILARITY, WIDTH, RECALL)
    often = rows_of.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.any_value("set_key").alias("set_key"))
    first = classes.where("root = node").select("doc_id", "text_key")
    same = often["doc_id"].eqNullSafe(first["doc_id"]) & (often["text_key"] == first["text_key"])
    kept = often.where("set_key is not null").join(first.hint("shuffle_hash"), same, "left_semi").unionByName(often.where("set_key is null"))
    key, other, number, n = fresh(docs, "_text_key", "_kept_key", "_kept_id", "_n")
    kept = cut(kept.select(F.col("doc_id").alias(number), F.col("text_key").alias(other), F.col("n").alias(n)))
    rows = docs.withColumn(key, text_key(F.col("text")))

    def those(which: DataFrame) -> DataFrame:
        return rows.join(which.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(which[number]) & (rows[key] == which[other]), "left_semi")

    once = those(kept.where(F.col(n) == 1))
    if not kept.where(F.col(n) > 1).limit(1).count():
        return once.select(*docs.columns)
    repeated = those(kept.where(F.col(n) > 1)).dropDuplicates(["doc_id", key])
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns))
