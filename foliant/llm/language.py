"""Language identification by language-bitmask n-gram filters.

Letter trigrams are counted by language over all training texts. A language keeps a trigram if it is common there, alone
and against other languages. The kept ones fill a bit-sliced Bloom filter: slots of 64 bits, one bit a language, and a
trigram sets its languages' bits in each of its slots. The bitwise and of a trigram's slots then names all languages that
hold it at once. A text goes to the language with the most hits after the expected false positives are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import cut, mix, segments, sliced, strings, table

N = 3
SLOTS, HASHES = 1 << 20, 2
#: A language keeps a trigram of this share of its own, at most 1 / LEAST_SHARE of them, and of this share of the
#: largest share that any language has.
LEAST_SHARE, LEAST_RATIO = 2e-5, 0.2
AT_ONCE = 1 << 20
UNKNOWN = "und"


def fold(of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Keys of the letter trigrams of lower-cased texts, words marked at both ends, the number of each text, and the
    first text's number; a text with letters has at least one. A long text comes in pieces."""
    at = 0
    while at < len(texts):
        last, size = at, 0
        while last < len(texts) and (last == at or size + len(texts[last]) <= AT_ONCE):
            size += len(texts[last]) + 2
            last += 1
        if last == at + 1:
            # cut where words end, so that each piece stands alone
            whole, begin = texts[at], 0
            while begin < max(len(whole), 1):
                end = whole.find(" ", begin + AT_ONCE)
                end = len(whole) if end < 0 else end
                yield *_trigrams([whole[begin:end]]), at
                begin = end + 1
        else:
            yield *_trigrams(texts[at:last]), at
        at = last


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "  " + "  ".join(x.lower() for x in texts) + "  "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:-1] |= is_letter[1:]
    where = np.flatnonzero(keep)
    c = np.where(is_letter, codes, 32)[where].astype(np.int64)
    if len(c) < N:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    keys = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    use = (c[1:-1] != 32) & (np.diff(where)[:-1] == 1) & (np.diff(where)[1:] == 1)
    lengths = np.array([len(x.lower()) + 2 for x in texts])
    starts = np.cumsum(lengths) - lengths + 2
    return keys[use], np.diff(np.searchsorted(where[1:-1][use], np.append(starts, len(codes))))


def slots_of(keys: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    h = mix(keys.astype(np.uint64))
    return [((h >> np.uint64(32 * i)) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts, langs = strings(batch.column(0)), batch.column(1).to_pylist()
        out: list[tuple] = []
        for lang in sorted(set(langs)):
            found = [k for k, _, _ in trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])]
            unique, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            out.append((unique, n, [lang] * len(unique)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([x[0] for x in out] or [np.zeros(0, np.int64)])),
                pa.array([x for y in out for x in y[2]], pa.string()),
                pa.array(np.concatenate([x[1] for x in out] or [np.zeros(0, np.int64)])),
            ],
            names=["g", "lang", "n"],
        )


@dataclass
class LanguageFilter:
    """langs: bit order; planes: for each 64 languages the slots; false: chance by language that all slots of a trigram
    it doesn't hold have its bit."""

    langs: list[str]
    planes: list[np.ndarray]
    false: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        hits = np.zeros((len(texts), max(len(self.langs), 1)))
        n = np.zeros(len(texts), np.int64)
        for keys, counts, at in trigrams(texts):
            some = np.flatnonzero(counts)
            n[at : at + len(counts)] += counts
            if not len(some):
                continue
            first = segments(counts)[some]
            slots = slots_of(keys)
            for i, plane in enumerate(self.planes):
                found = plane[slots[0]]
                for s in slots[1:]:
                    found = found & plane[s]
                for bit in range(min(64, len(self.langs) - 64 * i)):
                    one = ((found >> np.uint64(bit)) & np.uint64(1)).astype(np.int32)
                    hits[at + some, 64 * i + bit] += np.add.reduceat(one, first)
        # Of n trigrams, x held ones give x + (n - x) * false hits.
        held = np.clip((hits - n[:, None] * self.false) / (1 - self.false), 0, None) if self.langs else hits
        best = held.argmax(axis=1)
        total = held.sum(axis=1)
        # Languages share trigrams, so the lead over the others counts, not the share of all hits.
        share = np.where(total > 0, held[np.arange(len(texts)), best] / np.maximum(total, 1e-9), 0.0)
        out = [self.langs[b] if m and self.langs else UNKNOWN for b, m in zip(best.tolist(), n.tolist(), strict=True)]
        return out, np.where([x != UNKNOWN for x in out], share, 0.0)


def learn(training: DataFrame) -> LanguageFilter:
    """Filters of all languages of (text, lang) rows; null langs take no part. No rows give no languages."""
    counted = (
        training.where("lang is not null").select("text", "lang")
        .mapInArrow(_count, "g long, lang string, n long")
        .groupBy("g", "lang").agg(F.sum("n").alias("n"))
    )
    counted = cut(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in totals.select("lang").collect())
    # One row a language: bounded by the number of distinct languages, which the filter has a bit for each.
    shares = counted.join(F.broadcast(totals), "lang").select("g", "lang", (F.col("n") / F.col("total")).alias("p"))
    most = shares.groupBy("g").agg(F.max("p").alias("most"))
    kept = (
        shares.where(F.col("p") >= LEAST_SHARE)
        .join(most.hint("shuffle_hash"), "g")
        .where(F.col("p") >= LEAST_RATIO * F.col("most"))
        .select("g", "lang")
        .toPandas()  # at most 1 / LEAST_SHARE a language
    )
    number = {x: i for i, x in enumerate(langs)}
    index = kept["lang"].map(number).to_numpy(np.int64)
    planes, full = [np.zeros(SLOTS, np.uint64) for _ in range(0, len(langs), 64)], []
    keys = kept["g"].to_numpy(np.int64)
    for i in range(len(langs)):
        plane, bit = planes[i // 64], np.uint64(1 << (i % 64))
        for slots in slots_of(keys[index == i]):
            plane[np.unique(slots)] |= bit
        full.append(((plane & bit) != 0).mean() ** HASHES)
    return LanguageFilter(langs, planes, np.array(full) if full else np.zeros(1))


def identify(documents: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, held_out, lang_pred and score (share of the winner among the corrected counts) of every document. A text
    that is null or has no letter is `und` with score 0; equal counts go to the first language by name."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs, score = shared.value.predict(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    found = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, learn(documents.where(fold(4) != 2)))
