"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontamination, near_duplicates, packing, secrets, toxicity
from foliant.llm.common import forget, stored, table


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", near_duplicates.stage),
    ("decontamination", decontamination.stage),
    ("secrets", secrets.stage),
    ("packing", pack),
]

#: Learned models and token ids have no SQL form; tests hold a whole run against a plain Python one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; between them the rows are written to the shared folder as Parquet, and only the last such
    table stays.

    A null text is empty and stays so to packing, where it is one piece. Rows that share id and text are one document, rows
    that share an id only are two; rows without an id are documents too. Other columns pass through all stages but the
    last. An empty table gives no rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = stored(docs)
            if before:
                forget(spark, before)  # what it led to is written
            before = path
    return docs
