"""Shared helpers: table reads, written tables that cut lineage, Arrow batches, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Words are runs of digits, a-z and everything outside ASCII, after lower-casing A-Z; all other bytes become a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Bytes hashed at once; a single longer word widens its chunk.
CHUNK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set a local session, as in tests, gets a folder of its own; on a
    cluster that is an error, since executors don't share the driver's folders."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", "") or _own_folder
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        named = _own_folder = tempfile.mkdtemp(prefix="foliant-")
    return named.rstrip("/")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path. Lost executors cost no recomputation of what lies
    before it."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows, written out and read back."""
    return stored(df)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Removes a table of `stored` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until the rows have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Gives back to the system what this worker has freed: it lives on from stage to stage, and what allocators keep of each
    stage adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` and of about `size` bytes, because one text may be megabytes long.
    Spark bounds the bytes of the batches it sends by itself. Before the first one memory of earlier tasks is given back."""
    release()
    for batch in batches:
        n = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty string."""
    return [x or "" for x in column.to_pylist()]


def binary_words(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(WORD_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def multipliers(n: int) -> np.ndarray:
    """Odd numbers, one for each hash function."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


class Powers:
    """Powers of the hash base, widened on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 4096)
            for name, base in (("up", BASE), ("down", BASE_INV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for every span, independent of where the span lies. Texts can be made to collide, so
    whoever groups by it compares what it groups (distinct_spans)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = POWERS.get(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Space-ended joined texts of about CHUNK bytes, where each text starts, and the first text's number. A longer text
    comes alone, cut between words."""
    at = 0
    while at < len(texts):
        last, size = at, 0
        while last < len(texts) and (last == at or size + len(texts[last]) + 1 <= CHUNK):
            size += len(texts[last]) + 1
            last += 1
        if size > CHUNK + 1:
            whole, begin = texts[at], 0
            while begin < len(whole):
                end = whole.find(b" ", begin + CHUNK)
                end = len(whole) if end < 0 else end
                yield whole[begin:end] + b" ", np.zeros(1, np.int64), at
                begin = end + 1
        else:
            lengths = np.array([len(x) + 1 for x in texts[at:last]], np.int64)
            yield b" ".join(texts[at:last]) + b" ", np.cumsum(lengths) - lengths, at
        at = last


def word_spans(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a space-ended text, starts and ends of its words."""
    codes = np.frombuffer(joined, np.uint8)
    edge = np.diff((codes != 32).view(np.int8), prepend=np.int8(0))
    return codes, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def distinct_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal spans: each span's group, and the first span of each group. Hashes find them, then every span is
    compared with its group's first one, so spans whose hashes collide are told apart."""
    which, unique = pd.factorize(span_hashes(codes, starts, ends))
    first = np.empty(len(unique), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    again = np.flatnonzero(first[which] != np.arange(len(which)))
    model = first[which[again]]
    same = (ends - starts)[again] == (ends - starts)[model]
    wrong = [again[~same]]
    again, model = again[same], model[same]
    size = (ends - starts)[again]
    if len(again):
        edge = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(edge, size)
        unlike = codes[np.repeat(starts[model], size) + place] != codes[np.repeat(starts[again], size) + place]
        wrong.append(again[np.add.reduceat(unlike, edge) > 0])
    apart: dict[bytes, int] = {}
    for i in np.concatenate(wrong).tolist():
        key = codes[starts[i] : ends[i]].tobytes()
        if key not in apart:
            apart[key] = len(first)
            first = np.append(first, i)
        which[i] = apart[key]
    return which, first


#: Hashes of words seen before; forgotten when there are too many.
KNOWN: dict[bytes, int] = {}
MOST_KNOWN = 200_000


def word_hash(word: bytes) -> int:
    """64 bits of a cryptographic hash, for which no two words can be made to collide with little work."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of space-separated texts, and the number of words of each text."""
    found = [np.zeros(0, np.uint64)]
    counts = np.zeros(len(texts), np.int64)
    for joined, text_starts, at in chunks(texts):
        codes, starts, ends = word_spans(joined)
        which, first = distinct_spans(codes, starts, ends)
        if len(KNOWN) > MOST_KNOWN:
            KNOWN.clear()
        hashes = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            word = joined[a:b]
            h = KNOWN.get(word)
            if h is None:
                h = word_hash(word)
                if len(word) <= 64:
                    KNOWN[word] = h
            hashes.append(h)
        found.append(np.array(hashes, np.uint64)[which])
        counts[at : at + len(text_starts)] += np.diff(np.searchsorted(starts, text_starts), append=len(starts))
    return np.concatenate(found), counts


def segments(counts: np.ndarray) -> np.ndarray:
    """Start of each text's words in the joined array."""
    return np.cumsum(counts) - counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside each text, and their number by text; a shorter text that has words is
    one shingle."""
    starts = segments(counts)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.empty(int(n.sum()), np.uint64)
    offsets = segments(n)
    w = len(words) - width + 1
    if w > 0:
        rolled = np.zeros(w, np.uint64)
        for j in range(width):
            rolled = rolled * np.uint64(BASE) + words[j : j + w]
        long = counts >= width
        place = np.repeat(starts[long] - offsets[long], n[long])
        where = np.repeat(long, n)
        out[where] = rolled[np.flatnonzero(where) + place]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = len(words[starts[i] : starts[i] + counts[i]])
        for x in words[starts[i] : starts[i] + counts[i]].tolist():
            h = (h * BASE + x) & MASK
        out[offsets[i]] = h
    return mix(out), n
