"""Inventory operators: which files count, which are copies, what supersedes what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant import rules
from foliant.functions import text as T


def drop_hidden(inventory: DataFrame) -> DataFrame:
    """Without files that have a path segment starting with a dot; the path is relative to the archive's root."""
    return inventory.where(~F.exists(F.split("relative_path", "/"), lambda p: p.startswith(".")))


def drop_temp_office(inventory: DataFrame) -> DataFrame:
    return inventory.where(~F.col("file_name_original").startswith("~$"))


def stray_files(inventory: DataFrame) -> DataFrame:
    """Files directly in a year folder, with the reason why they are left out."""
    depth = F.size(F.split("relative_path", "/"))
    return inventory.where((depth == 2) & F.col("year_folder").rlike(r"^20\d{2}$")).select(
        "doc_id", "relative_path", F.lit("ignored_stray_year_file").alias("reason")
    )


def in_groups(inventory: DataFrame) -> DataFrame:
    """Year and branch parsed from the path; only files below a branch of a year folder."""
    part = F.split("relative_path", "/")
    return inventory.where((F.size(part) >= 3) & F.element_at(part, 1).rlike(r"^20\d{2}$")).withColumns(
        {"year_folder": F.element_at(part, 1), "proposal_branch": F.element_at(part, 2)}
    )


def classify_files(inventory: DataFrame) -> DataFrame:
    """Adds eligible_for_processing, processing_strategy, processing_status and skip_reason by extension."""
    ext = F.col("extension")
    sheet, direct = ext.isin(*rules.SHEET_EXTENSIONS), ext.isin(*rules.DIRECT_EXTENSIONS)
    eligible = sheet | direct
    reason = (
        F.when(ext.isin(*rules.IMAGE_EXTENSIONS), "ignored_image")
        .when(ext.isin(*rules.ZIP_EXTENSIONS), "zip_inventory_only")
        .when(ext.isin(*rules.DECK_EXTENSIONS), "powerpoint_inventory_only")
        .otherwise("unsupported_file_type")
    )
    return inventory.withColumns(
        {
            "eligible_for_processing": eligible,
            "processing_strategy": F.when(sheet, "local_extract_then_bedrock").when(direct, "direct_bedrock").otherwise("inventory_only"),
            "processing_status": F.when(eligible, "pending_analysis").otherwise("inventory_only"),
            "skip_reason": F.when(~eligible, reason),
        }
    )


def choose_strategy(
    inventory: DataFrame, max_direct_mb: float = 20, sheet_mb: float = 1, max_sheets: int = 3, max_cells: int = 500
) -> DataFrame:
    """Adds effective_strategy from size and sheet statistics (sheets, cells; -1 sheets: unreadable)."""
    mb = F.col("size_bytes") / (1024 * 1024)
    small = (mb <= sheet_mb) & F.col("sheets").between(0, max_sheets) & (F.col("cells") <= max_cells)
    sheet = F.col("extension").isin(*rules.SHEET_EXTENSIONS)
    direct = F.col("extension").isin(*rules.DIRECT_EXTENSIONS) & (mb <= max_direct_mb)
    return inventory.withColumn(
        "effective_strategy",
        F.when(F.when(sheet, small).otherwise(direct), "direct_bedrock").otherwise("local_extract_then_bedrock"),
    )


def duplicate_groups(inventory: DataFrame) -> DataFrame:
    """Contents that several files share: copies, first and last path in scan order. Partial aggregates only."""
    return (
        inventory.groupBy("sha256")
        .agg(
            F.count("*").alias("copies"),
            F.min_by("relative_path", "scan_ord").alias("first_path"),
            F.max_by("relative_path", "scan_ord").alias("kept_path"),
        )
        .where("copies > 1")
    )


def dedup_content(inventory: DataFrame, keep: str = "last") -> DataFrame:
    """One row per document_id: the last (or first) in scan order. A grouped maximum, so a content that many files share
    is no hot task."""
    rest = [c for c in inventory.columns if c not in ("document_id", "scan_ord")]
    best = F.max if keep == "last" else F.min
    picked = inventory.groupBy("document_id").agg(best(F.struct("scan_ord", *rest)).alias("_r"))
    return picked.select("document_id", "_r.*").select(*inventory.columns)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def mark_superseded_by_pdf(inventory: DataFrame) -> DataFrame:
    """Adds superseded_by_document_id to slide decks that have a PDF of the same stem in their folder; of several PDFs
    the last in scan order."""
    keyed = inventory.withColumn("_f", folder_of(F.col("relative_path"))).withColumn("_s", F.lower("stem"))
    pdfs = keyed.where("extension = '.pdf'").groupBy("_f", "_s").agg(
        F.max_by("document_id", "scan_ord").alias("superseded_by_document_id")
    )
    decks = keyed.where(F.col("extension").isin(*rules.DECK_EXTENSIONS)).join(pdfs.hint("merge"), ["_f", "_s"], "left")
    others = keyed.where(~F.col("extension").isin(*rules.DECK_EXTENSIONS)).withColumn(
        "superseded_by_document_id", F.lit(None).cast("string")
    )
    return others.unionByName(decks).drop("_f", "_s")


def slide_questions(inventory: DataFrame) -> DataFrame:
    """A review question for each deck without such a PDF."""
    return mark_superseded_by_pdf(inventory).where(
        F.col("extension").isin(*rules.DECK_EXTENSIONS) & F.col("superseded_by_document_id").isNull()
    ).select(
        F.concat(F.lit("q_"), F.substring(F.sha2("relative_path", 256), 1, 8)).alias("question_id"),
        "document_id", "relative_path", F.lit("medium").alias("priority"),
    )


def pending_documents(inventory: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Eligible files whose document isn't processed yet; at most `limit`, first in scan order."""
    pending = classify_files(inventory).where("eligible_for_processing").join(done.select("document_id").hint("merge"), "document_id", "left_anti")
    return pending.orderBy("scan_ord").limit(limit) if limit else pending


def resume_status(inventory: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: distinct documents, eligible, processed, pending and failed pending ones."""
    mark = lambda df, name: df.select("document_id").distinct().withColumn(name, F.lit(True)).hint("merge")
    ids = (
        classify_files(inventory).groupBy("document_id").agg(F.bool_or("eligible_for_processing").alias("eligible"))
        .join(mark(done, "done"), "document_id", "left").join(mark(failed, "failed"), "document_id", "left")
    )
    e, d = F.col("eligible"), F.coalesce("done", F.lit(False))
    return ids.agg(
        F.count("*").alias("total"), F.count_if(e).alias("eligible"), F.count_if(e & d).alias("processed"),
        F.count_if(e & ~d).alias("pending"), F.count_if(e & ~d & F.coalesce("failed", F.lit(False))).alias("failed_pending"),
    )


def resolve_name_collisions(files: DataFrame, folder: str | None = None, sanitize: bool = True) -> DataFrame:
    """Adds target_name: the safe name (or the name as it is) for the first file of a group, or of a folder in it, that has it;
    later ones get eight digits of their hash, and a number from 2 on if that is taken too. Numbers skip names that any file
    there has as its own, so no two files get one name."""
    stem = lambda c: F.regexp_extract(c, r"^(.+?)(\.[^.]*)?$", 1)
    ext = lambda c: F.regexp_extract(c, r"^.+?(\.[^.]*)?$", 1)
    place = ["proposal_id", *([folder] if folder else [])]
    first = Window.partitionBy(*place, "_safe").orderBy("scan_ord")
    again = Window.partitionBy(*place, "_name").orderBy("scan_ord")
    named = files.withColumn("_safe", T.safe_file_name(F.col("file_name_original")) if sanitize else F.col("file_name_original")).withColumn("_r", F.row_number().over(first))
    own = named.where("_r = 1").withColumn("target_name", F.col("_safe"))
    # Own names that are a later file's hashed name with some number: its base, and the number.
    number = F.regexp_extract(stem("_safe"), r"__[0-9a-f]{8}_([1-9][0-9]*)$", 1)
    base = F.concat(F.regexp_replace(stem("_safe"), r"_[1-9][0-9]*$", ""), ext("_safe"))
    taken = (
        own.select(*place, F.col("_safe").alias("_name"), F.lit(1).cast("long").alias("k"))
        .unionByName(own.where(number != "").select(*place, base.alias("_name"), number.cast("long").alias("k")).where("k > 1"))
        .groupBy(*place, "_name").agg(F.array_sort(F.collect_set("k")).alias("_taken"))
    )
    later = named.where("_r > 1").withColumn("_name", F.concat(stem("_safe"), F.lit("__"), F.substring("sha256", 1, 8), ext("_safe")))
    later = later.withColumn("_k", F.row_number().over(again).cast("long")).join(taken.hint("merge"), [*place, "_name"], "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_k"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    numbered = F.when(free == 1, F.col("_name")).otherwise(F.concat(stem("_name"), F.lit("_"), free.cast("string"), ext("_name")))
    later = later.withColumn("target_name", numbered)
    return own.select(*files.columns, "target_name").unionByName(later.select(*files.columns, "target_name"))
