"""Toxicity by class-conditional Kneser-Ney models of words, spelled letter by letter.

Toxic and ordinary training texts are counted as n-grams of the bytes of their words, up to six long, words marked at
both ends. Each class's estimate backs off to Kneser-Ney estimates from counts that both classes share, so an expression
that is rare in both counts alike for both, and a rare word is judged by its stem. A text is compared under the ordinary
model and under a toxic one that draws a few words in a thousand from toxic counts; the log-likelihood difference over
the text's length, calibrated on training rows that the counts don't use, is its score.

Counts cover every labelled training row and grow with them; no n-gram is dropped, however rare. The model is a pair of
written tables. If they are counted small they are sent to all tasks; else the distinct n-grams of the distinct words of
the texts are joined to them, and the words of each distinct text to the words' ratios.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.llm.common import (
    WORD_BYTES,
    chunks,
    cut,
    distinct_spans,
    fresh,
    segments,
    sliced,
    strings,
    table,
    word_spans,
)

ORDER = 6
#: A model of up to this number of n-grams and contexts is sent to all tasks (12 bytes each); a larger one is joined to
#: the texts' n-grams by a shuffle.
MODEL_BOUND = 8_000_000
#: Discounts of a class's counts and of shared counts; pseudo-count of the shared estimate.
CLASS_DISCOUNT, SHARED_DISCOUNT, SHARED_WEIGHT = 3.0, 0.75, 3.0
#: Share of a toxic text's words that the toxic counts are asked for; largest log ratio of one word.
TOXIC_SHARE, MOST_OF_A_WORD = 0.005, 12.0
#: Added to the length that a log-likelihood difference is divided by.
PRIOR_LENGTH = 30.0
#: Labelled rows up to this number are sent to all tasks (12 bytes each); more are joined by a shuffle.
LABELS_BOUND = 2_000_000
#: Distinct words counted, or remembered with their ratios, by a task at once.
WORDS_AT_ONCE = 400_000
#: Words whose values a task remembers before it starts anew.
REMEMBERED = 150_000
#: Width of the bins in which calibration counts scores, and the largest score that has its own bin.
BIN, MOST = 0.0005, 2.0
BEGIN, END = 94, 36  # ^ and $, which no word holds


def fold(of: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % of


def with_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, _toxic of the labelled documents; of several labels of a document the highest counts."""
    labels = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    labels = F.broadcast(labels) if labels.count() <= LABELS_BOUND else labels.hint("shuffle_hash")
    return documents.select("doc_id", "text").join(labels, "doc_id")


def words_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(WORD_BYTES)


def marked(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words as ^word$ one after another; of each byte its place in its word, and the start of each word."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    out = codes[np.clip(np.repeat(starts - 1, size) + place, 0, len(codes) - 1)].copy()
    out[begin] = BEGIN
    out[begin + size - 1] = END
    return out, place, begin


def packed(marks: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram that ends at each byte: its order, then its bytes; shorter where the word begins."""
    key = np.zeros(len(marks), np.int64)
    n = np.minimum(place + 1, order)
    for i in range(min(order, len(marks))):
        use = slice(i, None)
        back = marks[: len(marks) - i].astype(np.int64) << (8 * i)
        key[use] |= np.where(n[use] > i, back, 0)
    return key | (n << 48)


@dataclass
class ToxicityModel:
    """keys: sorted n-grams, ratio: their log ratios toxic to ordinary; contexts: sorted, lam: the log ratios of what
    follows them unseen; cut, slope: calibration."""

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    lam: np.ndarray
    cut: float = MOST
    slope: float = 1.0
    known: dict[bytes, float] = field(default_factory=dict)

    def word_ratios(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        marks, place, begin = marked(codes, starts, ends)
        value = look_up(packed(marks, place, ORDER), self.keys, self.ratio)
        unseen = np.flatnonzero(np.isnan(value) & (place > 0))
        before = packed(marks, place, ORDER - 1)[unseen - 1]
        value[unseen] = look_up(before, self.contexts, self.lam)
        value[begin] = 0.0
        return np.add.reduceat(np.nan_to_num(value, nan=0.0), begin) if len(begin) else np.zeros(0)

    def word_values(self, joined: bytes, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each word adds to a text's log-likelihood difference; words seen before are remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = np.array([i for i, w in enumerate(words) if w not in self.known], np.int64)
        if len(new):
            ratio = np.minimum(self.word_ratios(codes, starts[new], ends[new]), MOST_OF_A_WORD)
            values = np.log1p(TOXIC_SHARE * np.expm1(ratio)).tolist()
            self.known.update(zip([words[i] for i in new.tolist()], values, strict=True))
        return np.array([self.known[w] for w in words])

    def raw(self, texts: list[str]) -> np.ndarray:
        """Length-normalised log-likelihood difference of each text; 0 for a text without words."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for joined, text_starts, at in chunks([words_of(x) for x in texts]):
            codes, starts, ends = word_spans(joined)
            if not len(starts):
                continue
            which, first = distinct_spans(codes, starts, ends)
            value = self.word_values(joined, codes, starts[first], ends[first])[which]
            found = np.diff(np.searchsorted(starts, text_starts), append=len(starts))
            some = np.flatnonzero(found)
            total[at + some] += np.add.reduceat(value, segments(found)[some])
            n[at : at + len(found)] += found
        return total / (n + PRIOR_LENGTH)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(self.slope * (self.cut - self.raw(texts)), -60, 60)))


@dataclass
class ToxicityTables:
    """The same model as tables: ratios (g, ratio) and contexts (c, lam)."""

    ratios: DataFrame
    contexts: DataFrame
    cut: float = MOST
    slope: float = 1.0


def look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Value of each key, not a number where it isn't known."""
    if not len(known):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], np.nan)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n0, n1), with one counter of bounded size for all batches of a task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["w", "n0", "n1"])

    for batch in sliced(batches):
        for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[toxic > 0].update(words_of(text).split())
        if len(counts[0]) + len(counts[1]) > WORDS_AT_ONCE:
            yield flush()
    yield flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        words = batch.column(0).to_pylist()
        if not words:
            continue
        codes, starts, ends = word_spans(b" ".join(words) + b" ")
        marks, place, _ = marked(codes, starts, ends)
        n = [np.repeat(np.asarray(batch.column(c)), ends - starts + 2) for c in (1, 2)]
        found = []
        for order in range(1, ORDER + 1):
            use = np.flatnonzero(place >= max(order - 1, 1))
            unique, inverse = np.unique(packed(marks, place, order)[use], return_inverse=True)
            found.append((unique, *(np.bincount(inverse, x[use], len(unique)) for x in n)))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["g", "n0", "n1"])


def sums(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shorter(gram: Column, prefix: bool) -> Column:
    """Key of an n-gram without its last (prefix) or first byte."""
    order = F.shiftright(gram, 48)
    letters = gram.bitwiseAND(F.lit((1 << 48) - 1))
    rest = F.shiftright(letters, 8) if prefix else letters.bitwiseAND(
        F.expr("shiftleft(1L, cast(8 * (shiftright(g, 48) - 1) as int)) - 1")
    )
    return rest + (order - 1) * F.lit(1 << 48)


def fit(training: DataFrame, bound: int = MODEL_BOUND) -> ToxicityModel | ToxicityTables:
    """Counts a model over (text, _toxic) rows. Without rows of both classes it knows no difference."""
    words = sums(training.select("text", "_toxic").mapInArrow(_count_words, "w binary, n0 long, n1 long"), "w")
    grams = cut(sums(words.mapInArrow(_count_grams, "g long, n0 long, n1 long"), "g"))
    tables = estimate(grams)
    if tables.ratios.count() + tables.contexts.count() > bound:
        return tables
    ratios, contexts = (x.toPandas().sort_values(x.columns[0]) for x in (tables.ratios, tables.contexts))
    return ToxicityModel(
        ratios["g"].to_numpy(np.int64), ratios["ratio"].to_numpy(np.float32),
        contexts["c"].to_numpy(np.int64), contexts["lam"].to_numpy(np.float32),
    )


def estimate(grams: DataFrame) -> ToxicityTables:
    """Class estimates over shared interpolated Kneser-Ney estimates, as log ratios. Windows are by context, so of at most
    256 rows; shared estimates of an order are joined to those of the order below."""
    order = F.shiftright("g", 48)
    first = F.expr("shiftright(g, cast(greatest(8 * (shiftright(g, 48) - 1), 0) as int))").bitwiseAND(F.lit(0xFF))
    longer = grams.groupBy(shorter(F.col("g"), prefix=False).alias("g")).agg(F.count("*").alias("left"))
    context = Window.partitionBy("h")
    # Shared counts: tokens at the highest order and where words begin, else the number of different letters before.
    counted = (
        grams.join(longer.hint("shuffle_hash"), "g", "left")
        .withColumn("h", shorter(F.col("g"), prefix=True))
        .withColumn("top", (order == ORDER) | (first == BEGIN))
        .withColumn("n", F.when(F.col("top"), F.col("n0") + F.col("n1")).otherwise(F.coalesce("left", F.lit(0))).cast("double"))
        .withColumn("total", F.greatest(F.sum("n").over(context), F.lit(1.0)))
        .withColumn("kept", F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) / F.col("total"))
        .withColumn("back", 1 - F.sum("kept").over(context))
    )
    for k in (0, 1):
        less = F.greatest(F.col(f"n{k}") - CLASS_DISCOUNT, F.lit(0.0))
        counted = (
            counted.withColumn(f"t{k}", F.sum(f"n{k}").over(context) + SHARED_WEIGHT)
            .withColumn(f"n{k}", less)
            .withColumn(f"rest{k}", F.col(f"t{k}") - F.sum(f"n{k}").over(context))
        )
    counted = cut(counted.select("g", "h", "top", "kept", "back", "n0", "n1", "t0", "t1", "rest0", "rest1"))
    p = [(F.col(f"n{k}") + F.col(f"rest{k}") * F.col("shared")) / F.col(f"t{k}") for k in (0, 1)]
    below, found = None, []
    for k in range(1, ORDER + 1):
        rows = counted.where(order == k)
        if below is None:
            rows = rows.withColumn("low", F.lit(None).cast("double"))
        else:
            rows = rows.withColumn("suffix", shorter(F.col("g"), prefix=False)).join(
                below.select(F.col("g").alias("suffix"), F.col("shared").alias("low")).hint("shuffle_hash"), "suffix", "left"
            )
        shared = F.col("kept") + F.col("back") * F.coalesce("low", F.lit(1 / 256))
        below = rows.withColumn("shared", shared).select("g", "top", "shared", F.log(p[1] / p[0]).cast("float").alias("ratio"))
        below = cut(below)
        found.append(below.where("top").select("g", "ratio"))
    ratios = found[0]
    for x in found[1:]:
        ratios = ratios.union(x)
    lam = F.log(F.col("rest1") / F.col("t1")) - F.log(F.col("rest0") / F.col("t0"))
    contexts = counted.where("top").groupBy(F.col("h").alias("c")).agg(F.first(lam).cast("float").alias("lam"))
    return ToxicityTables(ratios, cut(contexts))


def scored(documents: DataFrame, model: ToxicityModel | ToxicityTables, raw: bool = False, name: str = "_score") -> DataFrame:
    """All columns of documents and the score under a name that they don't have; `raw`: before calibration."""
    if isinstance(model, ToxicityTables):
        return scored_by_join(documents, model, raw, name)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.raw if raw else shared.value.score
        for batch in sliced(batches):
            yield batch.append_column(name, pa.array(score(strings(batch.column(at))), pa.float64()))

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))


def _text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, w, n): how often each distinct text has each of its words."""
    for batch in sliced(batches):
        for text in set(strings(batch.column(0))):
            words = Counter(words_of(text).split())
            if words:
                columns = [pa.array([text_key(text)] * len(words)), pa.array(list(words), pa.binary()), pa.array(words.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "w", "n"])


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, g, c): each word with the n-gram that ends at each of its letters, and the context before it."""
    for batch in sliced(batches):
        words = batch.column(0).to_pylist()
        if not words:
            continue
        codes, starts, ends = word_spans(b" ".join(words) + b" ")
        marks, place, _ = marked(codes, starts, ends)
        at = np.flatnonzero(place > 0)
        which = np.repeat(np.arange(len(words)), ends - starts + 2)[at]
        columns = [pa.array(words, pa.binary()).take(pa.array(which)), *(pa.array(x) for x in (packed(marks, place, ORDER)[at], packed(marks, place, ORDER - 1)[at - 1]))]
        yield pa.RecordBatch.from_arrays(columns, names=["w", "g", "c"])


def text_key(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def scored_by_join(documents: DataFrame, model: ToxicityTables, raw: bool, name: str) -> DataFrame:
    """The same with a model of any size. A word comes once for each distinct text, so the commonest has a share of the
    rows that falls with the texts' lengths."""
    at = documents.columns.index("text")
    key, size, total = fresh(documents, "_k", "_n", "_total")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = strings(batch.column(at))
            n = [len(words_of(x).split()) for x in texts]
            found = pa.array([text_key(x) if k else None for x, k in zip(texts, n, strict=True)], pa.string())
            yield batch.append_column(key, found).append_column(size, pa.array(n, pa.int64()))

    rows = documents.mapInArrow(
        keys, T.StructType([*documents.schema.fields, T.StructField(key, T.StringType()), T.StructField(size, T.LongType())])
    )
    of_text = (
        documents.select("text").mapInArrow(_text_words, "k string, w binary, n long").groupBy("k", "w").agg(F.first("n").alias("n"))
    )
    ratio = F.least(F.sum(F.coalesce("ratio", "lam", F.lit(0.0))), F.lit(MOST_OF_A_WORD))
    of_word = (
        of_text.select("w").distinct().mapInArrow(_word_grams, "w binary, g long, c long")
        .join(model.ratios.hint("merge"), "g", "left").join(model.contexts.hint("merge"), "c", "left")
        .groupBy("w").agg(F.log1p(TOXIC_SHARE * F.expm1(ratio)).alias("value"))
    )
    totals = (
        of_text.join(of_word.hint("merge"), "w").groupBy(F.col("k").alias(key)).agg(F.sum(F.col("n") * F.col("value")).alias(total))
    )
    # Rows without words need no join.
    alone = rows.where(F.col(key).isNull()).withColumn(total, F.lit(0.0))
    beside = rows.where(F.col(key).isNotNull()).join(totals.hint("merge"), key, "left").select(*rows.columns, total)
    score = F.col(total) / (F.col(size) + PRIOR_LENGTH)
    if not raw:
        far = F.least(F.greatest(model.slope * (model.cut - score), F.lit(-60.0)), F.lit(60.0))
        score = 1.0 / (1.0 + F.exp(far))
    return alone.union(beside).select(*documents.columns, score.alias(name))


def calibrate(model: ToxicityModel | ToxicityTables, rows: DataFrame) -> ToxicityModel | ToxicityTables:
    """Sets the cut where F1 of the toxic class is best over labelled rows; only counts of score bins are gathered.
    Without rows of both classes nothing is toxic."""
    bins = (
        scored(rows.select("text", "_toxic"), model, raw=True)
        .groupBy(F.round(F.greatest(F.least("_score", F.lit(MOST)), F.lit(-MOST)) / BIN).cast("int").alias("b"))
        .agg(F.count_if(F.col("_toxic") <= 0).alias("n0"), F.count_if(F.col("_toxic") > 0).alias("n1"))
        .toPandas()
        .sort_values("b")
    )
    b, n0, n1 = (bins[c].to_numpy(float) for c in ("b", "n0", "n1"))
    if n0.sum() == 0 or n1.sum() == 0:
        return model
    hits, false = n1[::-1].cumsum()[::-1], n0[::-1].cumsum()[::-1]
    f1 = 2 * hits / (hits + false + n1.sum())
    i = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    low = b[i - 1] if i else b[i] - 1
    model.cut = float(BIN * (low + b[i]) / 2)
    apart = (b * n1).sum() / n1.sum() - (b * n0).sum() / n0.sum()
    model.slope = float(6.0 / max(BIN * apart, BIN))
    return model


def learn(documents: DataFrame, labels: DataFrame, bound: int = MODEL_BOUND) -> ToxicityModel | ToxicityTables:
    """Model of all labelled rows whose fold of 5 isn't 0: fold 1 calibrates, the others are counted."""
    labelled = with_labels(documents, labels)
    return calibrate(fit(labelled.where(fold(5) > 1), bound), labelled.where(fold(5) == 1))


def toxicity(documents: DataFrame, model: ToxicityModel | ToxicityTables) -> DataFrame:
    """doc_id, held_out, score (0..1), predicted of every document; a null text scores as an empty one, which has no
    evidence. Repeated rows are scored once each."""
    return scored(documents.select("doc_id", "text"), model).select(
        "doc_id",
        (fold(5) == 0).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, learn(documents, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't rejected as toxic, with their own columns."""
    model, name = learn(docs, table(spark, sf_dir, "labels")), fresh(docs, "_score")[0]
    return scored(docs, model, name=name).where(F.col(name) < 0.5).select(*docs.columns)
