"""Group roll-ups, and the clean set: what is left out and why, where the rest goes, manifests and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant import rules
from foliant.functions import text as T
from foliant.operators.aggregates import known
from foliant.operators.inventory import resolve_name_collisions


def folder_counts(documents: DataFrame, open_critical: DataFrame) -> DataFrame:
    """Included, excluded and reviewed documents of a group, its open critical questions (proposal_id, n_open), readiness."""
    kept, review = F.col("include_in_clean_set"), F.col("manual_review_required")
    counted = documents.groupBy("proposal_id").agg(
        F.count_if(kept).alias("n_included"), F.count_if(review).alias("n_review"),
        F.count_if(~kept & ~review).alias("n_excluded"),
    )
    n = F.coalesce("n_open", F.lit(0))
    return counted.join(open_critical.hint("merge"), "proposal_id", "left").select(
        *counted.columns, n.alias("n_open"), ((F.col("n_included") > 0) & (n == 0)).alias("ready")
    )


def priority_summary(documents: DataFrame) -> DataFrame:
    """Documents of a group by retrieval priority, and how many are under review."""
    level = {f"n_{p}": F.count_if(F.col("rag_priority") == p).alias(f"n_{p}") for p in ("high", "medium", "low", "exclude")}
    return documents.groupBy("proposal_id").agg(*level.values(), F.count_if("manual_review_required").alias("n_restricted"))


def detect_conflict(documents: DataFrame, field: str) -> DataFrame:
    """Groups with two or more known values of a field: the values in order, and how many documents state one. Values are
    made distinct by count before they are listed."""
    n = documents.where(known(field)).groupBy("proposal_id", F.col(field).alias("v")).agg(F.count("*").alias("n"))
    listed = n.groupBy("proposal_id").agg(F.array_sort(F.collect_list("v")).alias("v"), F.sum("n").alias("n_documents"))
    return listed.where("size(v) > 1").select("proposal_id", F.array_join("v", ", ").alias("conflicting"), "n_documents")


def select_full_text(documents: DataFrame, excluded_roles: tuple[str, ...], max_docs: int = 8, max_chars: int = 6000) -> DataFrame:
    """Documents whose start a group's summary request quotes: roles of high value first, then final versions; never roles
    of low value nor sensitive ones; a blank text takes no place. Both limits are the feature, a budget of a request."""
    sensitive = F.col("contains_budget_or_rates") | F.col("contains_personal_info")
    score = F.when(F.col("document_role").isin(*rules.HIGH_VALUE_ROLES), 0).otherwise(1)
    version = F.when(F.col("version_status").isin("final", "submitted_version"), 0).otherwise(1)
    order = Window.partitionBy("proposal_id").orderBy(score, version, "document_id", "scan_ord")
    fit = documents.where(~F.col("document_role").isin(*excluded_roles) & ~sensitive & (F.trim("summary_detailed") != ""))
    ranked = fit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_docs)
    return ranked.withColumn("excerpt", F.left(F.trim("summary_detailed"), F.lit(max_chars)))


def exclusion_reason(require_clearance: bool = True) -> Column:
    """Why a document isn't in the clean set: its own reason or a default, or the reasons of its review if a review has to
    clear it first; null if it is."""
    own = F.coalesce(F.nullif("exclude_reason", F.lit("")), F.lit("include_in_clean_set_false"))
    review = F.when(F.size("manual_review_reasons") > 0, F.concat(F.lit("manual_review_required: "), F.array_join("manual_review_reasons", "; ")))
    out = F.when(~F.col("include_in_clean_set"), own)
    return out.when(F.col("manual_review_required"), F.coalesce(review, F.lit("manual_review_required"))) if require_clearance else out


def exclusions(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    """Documents left out, and files that have no document, with the reason."""
    out = documents.withColumn("exclusion_reason", exclusion_reason()).where("exclusion_reason is not null")
    known_ids = documents.select("document_id").hint("merge")
    bare = inventory.join(known_ids, "document_id", "left_anti").withColumn(
        "exclusion_reason", F.concat(F.lit("no_document_metadata: "), F.coalesce("skip_reason", "processing_status"))
    )
    columns = ("doc_id", "document_id", "proposal_id", "relative_path", "exclusion_reason")
    return out.select(*columns).unionByName(bare.select(*columns))


def plan_clean_set(documents: DataFrame, sanitize: bool = True, flatten: bool = True, require_clearance: bool = True) -> DataFrame:
    """Adds clean_path to the documents that stay: their group's folder and a name that no other file there has. Without
    `sanitize` names stay as they are, without `flatten` the folders of the archive stay, in safe names, and names only have
    to differ inside one; without `require_clearance` documents that await a review stay too."""
    kept = documents.where(exclusion_reason(require_clearance).isNull())
    folders = F.slice(F.split("relative_path", "/"), 1, F.size(F.split("relative_path", "/")) - 1)
    inside = F.lit("") if flatten else F.array_join(F.transform(folders, lambda x: T.safe_file_name(x)), "/")
    kept = kept.withColumn("_inside", inside)
    placed = resolve_name_collisions(kept, "_inside", sanitize)
    path = T.recommended_key(F.col("year_folder"), F.col("proposal_branch"), F.lit("documents"), F.col("_inside"), F.col("target_name"))
    return placed.withColumn("clean_path", path).drop("_inside")


def manifest_rows(planned: DataFrame, lineage: DataFrame, groups: DataFrame, prefix: str = "archive") -> DataFrame:
    """The whole manifest: a row for each planned document, with its place, lineage, treatment and labels, and one for each
    group (proposal_id, year_folder, proposal_branch), its entry point for retrieval."""
    marks = lineage.select("doc_id", "authority_rank", "superseded_by_document_id", "contains_unique_reasoning", "recommended_treatment")
    j = planned.join(marks.hint("merge"), "doc_id", "left")
    key = lambda *parts: T.recommended_key(F.lit(prefix), *parts)
    place = (F.col("year_folder"), F.col("proposal_branch"))
    label = lambda c, name: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(name))
    documents = j.select(
        F.lit("document").alias("object_type"), "proposal_id", "document_id", "file_name_original", F.col("clean_path").alias("local_clean_path"),
        key(F.col("clean_path")).alias("recommended_key"), "include_in_future_rag", "rag_priority", "document_role", "version_status", "authority_rank",
        F.col("recommended_treatment").alias("recommended_rag_treatment"), (F.col("authority_rank") == "authoritative").alias("is_authoritative"),
        "superseded_by_document_id", "contains_unique_reasoning",
        F.array_compact(F.array(label("contains_budget_or_rates", "budget_or_rates"), label("contains_personal_info", "personal_info"))).alias("sensitivity_labels"),
        F.col("proposal_id").alias("parent_proposal_record"),
    )
    kinds = {f.name: f.dataType for f in documents.schema.fields}
    given = {
        "object_type": F.lit("proposal_record"), "proposal_id": F.col("proposal_id"), "local_clean_path": T.recommended_key(*place, F.lit("metadata"), F.lit("retrieval.json")),
        "recommended_key": key(*place, F.lit("metadata"), F.lit("proposal.json")), "include_in_future_rag": F.lit(True), "rag_priority": F.lit("high"),
    }
    records = groups.select(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in documents.columns))
    return documents.unionByName(records)


def manifest(planned: DataFrame, prefix: str = "archive") -> DataFrame:
    """A row for each planned document and one for each group among them."""
    documents = planned.select(
        F.lit("document").alias("object_type"), "proposal_id", "document_id", T.recommended_key(F.lit(prefix), F.col("clean_path")).alias("key")
    )
    groups = planned.select("proposal_id", "year_folder", "proposal_branch").distinct().select(
        F.lit("proposal").alias("object_type"), "proposal_id", F.lit(None).cast("string").alias("document_id"),
        T.recommended_key(F.lit(prefix), F.col("year_folder"), F.col("proposal_branch"), F.lit("metadata"), F.lit("proposal.json")).alias("key"),
    )
    return documents.unionByName(groups)


def provenance(treated: DataFrame) -> DataFrame:
    """Documents by group and what became of them, one row each rather than lists that grow with the group."""
    fate = (
        F.when(F.col("recommended_treatment") == "exclude", "excluded").when(F.col("authority_rank") == "authoritative", "authoritative")
        .when(F.col("contains_unique_reasoning"), "retained").otherwise("downgraded")
    )
    return treated.select("proposal_id", "doc_id", "document_id", fate.alias("fate"), "policy_applied")
