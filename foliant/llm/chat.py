"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own, a row with all turns before it spelled out as context and its reply
as the only part with loss. What contexts take grows with the square of a conversation's turns; who can do with less context
may ask for blocks of turns. Turns after the last reply get a row without loss.

Template: `<turn ROLE>` newline, text, `</turn>` newline. In roles and texts a backslash becomes `\\b`, `<` becomes `\\l`
and `>` becomes `\\g`, so no control string occurs in them, and the escape is undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import sliced, table

OPEN, CLOSE = "<turn ", "</turn>\n"
TURN = re.compile(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n")
#: Fixed values of the contract: the conversation that is added, and what both its turns say.
ADDED_ID, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(text: str) -> str:
    for plain, coded in reversed(ESCAPES):
        text = text.replace(coded, plain)
    return text


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, conv_key, turn_no (from 0), segment (formatted turn), size (of its escaped text),
    is_target (an assistant's).

    Turns are ordered by turn, then role and text, so ties and repeated rows have a defined order; null turns come
    first. Null roles and texts are empty. A row without conv_id belongs to no conversation and is one by itself, together
    only with rows that are the same in turn, role and text.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    alone = F.concat(F.lit("row "), F.md5(F.concat_ws("\n", F.col("turn").cast("string"), "role", "text")))
    in_order = Window.partitionBy("conv_key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (
        rows.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), alone))
        .withColumn("turn_no", F.row_number().over(in_order) - 1)
        .withColumn("_text", escape(F.col("text")))
        .select(
            "conv_id", "conv_key", "turn_no",
            F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">\n"), "_text", F.lit(CLOSE)).alias("segment"),
            F.length("_text").alias("size"), (F.col("role") == "assistant").alias("is_target"),
        )
    )


def examples(formatted: DataFrame, block_turns: int | None = None) -> DataFrame:
    """One row per reply, and one for turns without a reply after them: conv_id, conv_key, block, turn_no, text (all turns up
    to and with this one), loss_start and loss_end (offsets of the reply's text in it, null without loss). With block_turns
    a conversation is cut into blocks of so many turns, and a text begins with its block."""
    block = Window.partitionBy("conv_key", "block").orderBy("turn_no")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    end = F.length("text") - len(CLOSE)
    return (
        formatted.withColumn("block", F.floor(F.col("turn_no") / block_turns) if block_turns else F.lit(0).cast("long"))
        .withColumn("text", F.array_join(F.collect_list("segment").over(upto), ""))
        .withColumn("_last", F.lead("turn_no").over(block).isNull())
        .where("is_target or _last")
        .select(
            "conv_id", "conv_key", "block", "turn_no", "text",
            F.when(F.col("is_target"), end - F.col("size")).alias("loss_start"), F.when(F.col("is_target"), end).alias("loss_end"),
        )
    )


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_examples long"
)


def read_back(made: DataFrame) -> DataFrame:
    """Digests by conversation, from the examples alone: roles and texts are parsed out of their contexts, losses cut out
    at their offsets. formatted_chars counts what the examples hold, no more. Examples of one block must agree in what they
    share. Rows stream past in order; the context of one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        now, state, done = None, None, []
        block, context = 0, ""

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 7
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def close(s: list) -> None:
            done.append((s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]))

        for batch in sliced(batches):
            for conv, key, number, text, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or key != now:
                    if state is not None:
                        close(state)
                    now, state = key, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    block, context = number, ""
                if number != block:
                    block, context = number, ""
                if not text.startswith(context):
                    raise ValueError(f"examples of conversation {conv} differ in their context")
                for m in TURN.finditer(text, len(context)):
                    state[1] += 1
                    state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "replace"))
                context = text
                if a is not None:
                    reply = unescape(text[a:b])
                    state[3] += len(reply)
                    state[4].update(reply.encode("utf-8", "replace"))
                    state[5] += len(text)
                    state[6] += 1
            yield flush()
        if state is not None:
            close(state)
            yield flush()

    return (
        made.repartition("conv_key").sortWithinPartitions("conv_key", "block", "turn_no")
        .select("conv_id", "conv_key", "block", "text", "loss_start", "loss_end").mapInArrow(run, DIGEST)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """formatted_chars: code points of all examples together, each with its whole context."""
    added = spark.range(2).select(
        F.lit(ADDED_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ADDED_TEXT).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(examples(format_turns(rows.unionByName(added))))


#: The template's lengths are those of the module: 6 + role + 2 before a text, 8 after it.
ORACLE_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
    SELECT *, length(role || text) + 16 + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS n,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM turns),
summed AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars,
    count(*) FILTER (role = 'assistant') AS n_examples
FROM summed GROUP BY conv_id
"""
