"""Where a model is plugged in: requests in; answers, errors and usage out, each call made once.

A scorer takes a pandas batch of requests and gives a row for each. If it raises, its batch is halved until the requests at
fault stand alone, so one bad document costs no other one its answer. What was called is written before anything reads it:
neither a lost executor behind that table nor a second output calls a model again. Retries are passes over the rows that
failed: a document too large for direct upload goes again as extracted text, an answer that isn't valid goes back for repair.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import responses as R
from foliant.sources.tables import stored

#: Requests of one call of a scorer, and characters in it unless one request has more.
BATCH, BATCH_CHARS = 64, 4_000_000
MOST_CHARS = 200_000
#: Of the batches that Spark sends so many rows and about so many bytes are taken at once.
SLICE_ROWS, SLICE_BYTES = 16 * BATCH, 1 << 22
REQUEST = ("document_id", "pass_number", "strategy", "prompt")
ANSWER = ("raw_text", "input_tokens", "output_tokens")
CALLS = (
    "document_id string, pass_number int, strategy string, prompt_chars long, raw_text string, input_tokens long, "
    "output_tokens long, success boolean, error_type string, error_message string, started_at timestamp, latency double"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC"), "double": pa.float64()}
CALLED = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in CALLS.split(", "))])
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
# Types of failures.
CALL_FAILED, REPAIR_FAILED, INVALID = "bedrock_call_failed", "repair_bedrock_failed", "validation_failed"


class Scored(NamedTuple):
    """Valid answers, a usage row for each call, and a row for each document that has no valid answer; all calls."""

    responses: DataFrame
    usage: DataFrame
    failures: DataFrame
    calls: DataFrame


def checked_answer(scorer: Scorer, requests: pd.DataFrame) -> pd.DataFrame:
    out = scorer(requests)
    if len(out) != len(requests) or any(c not in out.columns for c in ANSWER):
        raise ValueError(f"a scorer gives a row a request with {', '.join(ANSWER)}")
    return out[list(ANSWER)].reset_index(drop=True)


def isolated(scorer: Scorer, requests: pd.DataFrame) -> pd.DataFrame:
    """Answers of a batch, in its order. Requests at fault have their error in place of an answer."""
    parts, todo = [], [(0, len(requests))]
    while todo:
        start, end = todo.pop()
        some, began, clock = requests.iloc[start:end].reset_index(drop=True), pd.Timestamp.now(tz="UTC"), time.perf_counter()
        try:
            out = checked_answer(scorer, some).assign(error_type=None, error_message=None)
        except Exception as e:  # noqa: BLE001  (whatever a plugged-in function raises is the row's error)
            if end - start > 1:
                half = (start + end) // 2
                todo += [(half, end), (start, half)]
                continue
            out = pd.DataFrame([{c: None for c in ANSWER} | {"error_type": type(e).__name__, "error_message": str(e)}])
        parts.append(out.assign(started_at=began, latency=(time.perf_counter() - clock) / (end - start)))
    return pd.concat(parts, ignore_index=True)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few megabytes at a time: as pandas objects a whole batch of long texts takes several times its bytes."""
    for batch in batches:
        n = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def pieces(batch: pd.DataFrame, rows: int, chars: int) -> Iterator[pd.DataFrame]:
    """The batch in runs of at most `rows` requests and about `chars` characters."""
    size = batch["prompt"].fillna("").str.len().to_numpy()
    start = total = 0
    for i, n in enumerate(size):
        if i > start and (i - start >= rows or total + n > chars):
            yield batch.iloc[start:i].reset_index(drop=True)
            start, total = i, 0
        total += n
    if start < len(batch):
        yield batch.iloc[start:].reset_index(drop=True)


def call(requests: DataFrame, scorer: Scorer, batch: int = BATCH) -> DataFrame:
    """A row for each request (document_id, pass_number, strategy, prompt), made by one call each and written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches):
            for some in pieces(whole.to_pandas(), batch, BATCH_CHARS):
                out = pd.concat([some[["document_id", "pass_number", "strategy"]], isolated(scorer, some)], axis=1)
                out["prompt_chars"] = some["prompt"].fillna("").str.len()
                out["success"] = out["error_type"].isna()
                for c in ("input_tokens", "output_tokens"):
                    out[c] = out[c].astype("Int64")
                yield pa.RecordBatch.from_pandas(out[CALLED.names], CALLED, preserve_index=False)

    return stored(requests.select(*REQUEST).mapInArrow(run, CALLS))


def score_documents(
    documents: DataFrame, scorer: Scorer, checks: Callable[[], dict[str, Column]] = R.response_checks, repair: bool = True,
    batch: int = BATCH, most_chars: int = MOST_CHARS,
) -> Scored:
    """Asks a scorer about documents (document_id, processing_strategy, text, extracted), each id once.

    Direct ones are asked with their text, others with at most most_chars characters of extracted text (a budget of a
    request). A direct one that is refused for its size is asked again with extracted text. Answers are read strictly and
    checked; one that fails goes back once with the failed checks, if `repair`. No documents give no rows."""
    extracted = T.request_text(F.col("extracted"), most_chars)
    direct = F.col("processing_strategy") == "direct_bedrock"
    first = documents.select(
        "document_id", F.lit(1).alias("pass_number"), F.col("processing_strategy").alias("strategy"),
        F.when(direct, F.coalesce("text", F.lit(""))).otherwise(extracted).alias("prompt"),
    )
    asked = call(first, scorer, batch)
    refused = T.size_limit_error(F.col("strategy"), F.col("error_message"))
    large = asked.where(~F.col("success") & refused).select("document_id", F.col("error_message").alias("direct_upload_error"))
    again = call(
        documents.join(large.hint("merge"), "document_id").select(
            "document_id", F.lit(1).alias("pass_number"), F.lit("local_extract_then_bedrock").alias("strategy"), extracted.alias("prompt")
        ),
        scorer, batch,
    )
    settled = asked.where(F.col("success") | ~refused).unionByName(again)
    good, bad = R.validate(R.response_fields(R.parse_strict(settled.where("success"))), checks())
    why = F.array_join("violations", ",")
    repaired = call(
        bad.where(F.lit(repair)).select("document_id", F.lit(2).alias("pass_number"), "strategy", F.concat_ws("\n", why, "raw_text").alias("prompt")),
        scorer, batch,
    )
    mended, broken = R.validate(R.response_fields(R.parse_strict(repaired.where("success"))), checks())
    attempts = [(asked, 1), (again, 2), (repaired, 3)]
    calls = None
    for rows, attempt in attempts:
        rows = rows.withColumn("attempt", F.lit(attempt))
        calls = rows if calls is None else calls.unionByName(rows)
    failure = lambda rows, kind, message: rows.select(
        "document_id", F.lit(kind).alias("error_type"), message.alias("details"), F.left("raw_text", F.lit(500)).alias("preview")
    )
    unsent = bad if not repair else broken
    failed = (
        failure(settled.where("not success"), CALL_FAILED, F.col("error_message"))
        .unionByName(failure(repaired.where("not success"), REPAIR_FAILED, F.col("error_message")))
        .unionByName(failure(unsent, INVALID, why))
    )
    failed = failed.join(large.hint("merge"), "document_id", "left")
    usage = calls.select(
        "document_id", "attempt", "pass_number", "strategy", "success", "input_tokens", "output_tokens",
        (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("total_tokens"),
        "error_type", "error_message", "started_at", "latency",
    )
    return Scored(good.unionByName(mended), usage, failed, calls)
