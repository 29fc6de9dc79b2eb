"""Quality rules: counts of whole texts, and a logistic regression over hashed word and character n-grams.

The regression is learned by Spark's own on labelled rows that pass the fixed rules, its margin is turned into a probability
on rows it hasn't learned from, and all texts are scored in Arrow batches against a fixed threshold. A text's features are
the shares of its n-grams that fall in each bucket, kind by kind, so a score is a sum of mean weights and needs no vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import BASE, CHUNK, cut, mix, sliced, strings, table

#: Fixed values of the rules.
SYMBOLS, SPACES, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", b" \t\n\v\f\r", 50, 50
#: Words and characters in an n-gram, buckets, and the factor that brings shares to the size of ones.
WORD_SIZES, CHAR_SIZES, BITS, GAIN = (1, 2), (2, 4), 16, 100.0
#: Labelled documents that are learned and calibrated from, at most about so many, chosen by a hash of their id.
MOST_LABELLED = 10_000
#: Of five folds one is never looked at, one calibrates, three are learned from.
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 1
#: The least probability of good quality with which a text is kept.
KEEP_AT = 0.5
PENALTY, CALIBRATION_PENALTY = 1e-4, 1e-4


def read_words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Every word of a text by the number of its first use, and the different words. The text is split in stretches."""
    first: dict[bytes, int] = {}
    number, at, found = count(), 0, [np.zeros(0, np.int64)]
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in SPACES:
            end += 1
        words = data[at:end].split()
        found.append(np.fromiter(map(first.setdefault, words, number), np.int64, len(words)))
        at = end
    places = np.concatenate(found)
    new = np.fromiter(first.values(), np.int64, len(first))
    return np.searchsorted(new, places), list(first)


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """Words that lie in windows found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    code = words[:n]
    for j in range(1, width):
        code = np.unique(code, return_inverse=True)[1] * (int(words.max()) + 1) + words[j : j + n]
    _, which, times = np.unique(code, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(words), bool)
    for j in range(width):
        covered[again + j] = True
    return int(covered.sum())


def counts_of(text: str, data: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def buckets(text: str, words: np.ndarray, different: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, buckets of n-grams) of a whole text; a long text's characters come in stretches."""
    base = np.uint64(BASE)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))[words]
    for kind, size in enumerate(WORD_SIZES):
        n = len(hashes) - size + 1
        if n > 0:
            h = hashes[:n]
            for j in range(1, size):
                h = h * base + hashes[j : j + n]
            yield kind, bucket(h, kind)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK + max(CHAR_SIZES) - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        for kind, size in enumerate(CHAR_SIZES, len(WORD_SIZES)):
            n = min(len(codes) - size + 1, CHUNK)
            if n > 0:
                h = codes[:n] + np.uint64(1)
                for j in range(1, size):
                    h = h * base + codes[j : j + n] + np.uint64(1)
                yield kind, bucket(h, kind)


def features(found: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in use, and the share of the n-grams of each kind in them, times GAIN."""
    by_kind: dict[int, np.ndarray] = {}
    for kind, at in found:
        by_kind[kind] = by_kind.get(kind, 0) + np.bincount(at, minlength=1 << BITS)
    total = sum((GAIN / n.sum() * n for n in by_kind.values()), np.zeros(1 << BITS))
    used = np.flatnonzero(total)
    return used, total[used]


def margin(found: Iterator[tuple[int, np.ndarray]], weights: np.ndarray, intercept: float) -> float:
    sums: dict[int, tuple[float, int]] = {}
    for kind, at in found:
        s, n = sums.get(kind, (0.0, 0))
        sums[kind] = s + float(weights[at].sum()), n + len(at)
    return intercept + sum(GAIN * s / n for s, n in sums.values())


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def examples(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """quality, fold, places, shares of labelled documents outside the held-out fold that pass the rules, as a table. An id
    labelled both ways is left out; of rows that share an id the text with the least hash counts."""
    sure = (
        labels.where("doc_id is not null and quality is not null").withColumn("fold", fold()).where(F.col("fold") != HELD_OUT)
        .groupBy("doc_id", "fold").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    )
    share = most / max(1, sure.count())
    chosen = sure.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)))  # about `most` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            keep, places, shares = [], [], []
            for i, text in enumerate(strings(batch.column(0))):
                data = text.encode("utf-8", "replace")
                words, different = read_words(data)
                if not fails(len(words), repeated_words(words)):
                    used, x = features(buckets(text, words, different))
                    keep.append(i)
                    places.append(used)
                    shares.append(x)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(1), kept.column(2), pa.array(places, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))],
                names=["quality", "fold", "places", "shares"],
            )

    met = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id", "quality", "fold").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return cut(
        one.select("text", F.col("quality").cast("double"), "fold").mapInArrow(run, "quality double, fold int, places array<int>, shares array<double>")
    )


class Model:
    """Weights by bucket, intercept, and slope and offset that turn a margin into a probability. None: no model."""

    def __init__(self, weights: np.ndarray | None, intercept: float = 0.0, slope: float = 1.0, offset: float = 0.0) -> None:
        self.weights, self.intercept, self.slope, self.offset = weights, intercept, slope, offset

    def probability(self, found: Iterator[tuple[int, np.ndarray]]) -> float | None:
        if self.weights is None:
            return None
        z = self.slope * margin(found, self.weights, self.intercept) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learns weights from three folds and calibrates on one. Where either lacks a label there is no model."""
    rows = examples(documents, labels, most)
    learns = F.col("fold") != CALIBRATES
    seen = rows.groupBy(learns.alias("learns"), "quality").count().collect()  # four rows at most
    if len({(r["learns"], r["quality"]) for r in seen if r["quality"] in (0, 1)}) < 4:
        return Model(None)
    vector = F.udf(lambda at, x: Vectors.sparse(1 << BITS, at, x), VectorUDT())
    learner = LogisticRegression(featuresCol="x", labelCol="quality", maxIter=100, tol=1e-9, regParam=PENALTY, standardization=False)
    known = rows.where(F.col("quality").isin(0.0, 1.0)).where(F.size("places") > 0)
    vectors = known.select("quality", learns.alias("learns"), vector("places", "shares").alias("x"))
    model = learner.fit(vectors.where("learns"))
    margins = model.transform(vectors.where("not learns")).select("quality", F.slice(vector_to_array("rawPrediction"), 2, 1).alias("m"))
    sigmoid = learner.copy({learner.regParam: CALIBRATION_PENALTY}).fit(margins.select("quality", array_to_vector("m").alias("x")))
    weights, intercept = model.coefficients.toArray(), float(model.intercept)
    return Model(weights, intercept, float(sigmoid.coefficients[0]), float(sigmoid.intercept))


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, held_out boolean, score double"
)


def judge(documents: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per row of documents: counts, whether the rules fail it, its probability of good quality, and the verdict."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text in strings(batch.column(2)):
                data = text.encode("utf-8", "replace")
                words, different = read_words(data)
                counts = counts_of(text, data, words)
                failed = fails(counts[0], counts[4])
                score = shared.value.probability(buckets(text, words, different))
                rows.append((*counts, failed, not failed and (score is None or score >= keep_at), score))
            found = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64()]
            cells = [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *cells[:7], batch.column(1), cells[7]],
                names=[x.split(" ")[0] for x in RESULT.split(", ")],
            )

    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return documents.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(run, RESULT)


def quality_rules(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per row of documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    held_out, score.

    A null text has no words and fails; texts of any length are read whole. Repeated rows are judged once each, rows without
    id too. Without labelled rows of both kinds to learn and calibrate from there is no model: scores are null and the rules
    alone decide. Labels without id or quality, and ids labelled both ways, aren't learned from. An empty table gives no
    rows. Other columns are not looked at."""
    return judge(documents, fit(documents, labels, most), keep_at)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
