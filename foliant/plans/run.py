"""The stages of a run strung together. run_all stays lazy; run_archive writes its tables by run and goes on where runs before
it ended; a dry run of it is one without sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import answers as N
from foliant.operators import classify as C
from foliant.operators import clean_set as S
from foliant.operators import decisions as D
from foliant.operators import identity as Y
from foliant.operators import inventory as I
from foliant.operators import records as K
from foliant.operators import scoring as Q
from foliant.operators import second_pass as Z
from foliant.operators import tracker as M
from foliant.sources import tables as W


def synthesize(own: DataFrame, model: DataFrame | None, fields: Sequence[str]) -> DataFrame:
    """Groups' records with a model's values (proposal_id, fields, valid) where they are valid; what was computed stands
    where they aren't. synthesis_source says which."""
    if model is None:
        return own.withColumn("synthesis_source", F.lit("deterministic"))
    side = model.where("valid").select("proposal_id", F.lit(True).alias("_given"), *(F.col(c).alias(f"_{c}") for c in fields))
    j = own.join(side.hint("merge"), "proposal_id", "left")
    new = {c: F.when(F.col("_given"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in fields}
    source = F.when(F.col("_given"), "model").otherwise("deterministic_fallback")
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in own.columns), source.alias("synthesis_source"))


def run_all(inventory: DataFrame, details: DataFrame, tracker: DataFrame, allow_open: bool = False, questions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a whole run over an inventory (doc_id, document_id, proposal_id, paths, stem, extension, scan_ord, sha256,
    size_bytes) and documents' details (doc_id, summaries, inclusion, review and proposal facts): documents, lineage,
    proposals, key documents, plan, exclusions, manifest. An open critical question stops it unless allowed."""
    if questions is not None:
        K.critical_gate(questions, allow_open)
    found = I.dedup_content(I.drop_temp_office(I.drop_hidden(inventory)))
    labelled = C.classify_documents(found.where("proposal_branch is not null"))
    extra = [c for c in details.columns if c != "doc_id"]
    documents = labelled.drop(*extra).join(details.hint("merge"), "doc_id").withColumn("ord", F.concat_ws("|", "document_id", "scan_ord"))
    treated = C.treatments(C.lineage(documents))
    groups = documents.select("proposal_id", "proposal_branch").distinct()
    proposals = Y.canonical_identity(documents, Y.matched_rows(M.match_tracker(groups, tracker), tracker), "ord")
    planned = S.plan_clean_set(documents)
    return {
        "documents": documents, "lineage": treated, "proposals": synthesize(proposals, None, ()),
        "plan": planned, "exclusions": S.exclusions(documents, I.classify_files(found)), "manifest": S.manifest(planned),
    }


#: Values that a model's answer may replace in a record, and what else a document needs.
SCORED = ("document_category", "document_role", "origin_type", "status")
ANSWERABLE = ("include_in_clean_set", "document_category", "status", "canonical_proposal_name", "rag_priority")


def earlier(spark, home: str, name: str) -> DataFrame | None:
    path = f"{home}/{name}"
    return spark.read.parquet(path) if W.exists(spark, path) else None


def newest(rows: DataFrame) -> DataFrame:
    """Of each document the record of its last run, by name."""
    rest = [c for c in rows.columns if c not in ("document_id", "run_id")]
    picked = rows.groupBy("document_id").agg(F.max_by(F.struct(*rest), "run_id").alias("_r"))
    return picked.select("document_id", "_r.*")


def described(pending: DataFrame, scorer: Q.Scorer | None) -> tuple[DataFrame, Q.Scored | None]:
    """Records of pending files: by rules, and where a scorer is given with its valid answers' values; documents without a
    valid answer have no record then."""
    records = C.with_records(C.classify_documents(pending))
    if scorer is None:
        return records, None
    texts = pending.select("document_id", "processing_strategy", F.col("summary_short").alias("text"), F.col("summary_detailed").alias("extracted"))
    scored = Q.score_documents(texts, scorer)
    side = scored.responses.select("document_id", *(F.col(c).alias(f"_{c}") for c in SCORED), F.col("confidence").alias("_sure"))
    met = records.join(side.hint("merge"), "document_id")
    taken = {c: F.coalesce(f"_{c}", c) for c in SCORED} | {f"{c}_confidence": F.coalesce("_sure", f"{c}_confidence") for c in SCORED}
    noted = F.array().cast("array<string>")
    return met.withColumns(taken | {"processing_notes": noted}).select(*records.columns), scored


def run_archive(
    inventory: DataFrame, tracker: DataFrame, home: str, run_id: str, scorer: Q.Scorer | None = None,
    review: Callable[[DataFrame], DataFrame] | None = None, answers: DataFrame | None = None, scope: Column | None = None, limit: int | None = None,
    resume: bool = True, allow_open: bool = False, dry_run: bool = False, threshold: float = 0.75,
) -> dict[str, DataFrame]:
    """A run over an inventory (files with texts) and a tracker, its tables below `home` by run_id.

    Only files in `scope`, at most `limit` of them, are described, and with `resume` none that an earlier run described. The
    review function looks again at records that need it; answers of people (document_id, field, user_answer, status, seq) are
    applied to all records. Groups, decisions, questions, the clean set and its manifest are made anew of all records, of
    earlier runs too. Critical questions that are open stop the run before the clean set, unless allowed; what was described
    is kept. A dry run writes nothing and asks no scorer. Running a run_id again replaces what it wrote."""
    spark = inventory.sparkSession
    files = I.drop_temp_office(I.drop_hidden(inventory)).where("proposal_branch is not null")
    found = I.classify_files(I.dedup_content(files if scope is None else files.where(scope)))
    before = earlier(spark, home, "documents") if resume else None
    before = before.where(F.col("run_id") != run_id) if before is not None else None
    waiting = found.where("eligible_for_processing")
    if before is not None:
        waiting = waiting.join(before.select("document_id").distinct().hint("merge"), "document_id", "left_anti")
    if limit:
        waiting = waiting.orderBy("scan_ord").limit(limit)
    out: dict[str, DataFrame] = {"pending": waiting.select("document_id", "relative_path", "processing_strategy")}
    if dry_run:
        return out
    audit, counts = f"{home}/audit", {}
    W.write_run_manifest(spark, audit, run_id, 1, "run", "resumed" if before is not None else "full", "started", {})
    records, scored = described(W.stored(waiting), scorer)
    records = W.stored(records)
    if scored is not None:
        for name, rows in (("usage", scored.usage), ("failures", scored.failures)):
            W.write_table(rows, f"{home}/{name}", run_id)
        W.write_raw_responses(scored.calls.where("success"), f"{home}/raw", run_id)
        counts["failures"] = scored.failures.count()
    if review is not None:
        doubtful = records.withColumns({"reviewed_twice": F.lit(False), "rag_confidence": F.col("rag_priority_confidence")}).where(
            Z.needs_review(threshold)
        )
        again = review(doubtful).select("document_id", *(c for pair in Z.MERGED for c in pair), "uncertainties", "processing_notes")
        merged = Z.merge_records(records, again, "document_id", threshold=threshold)
        W.write_table(Z.change_log(merged, "document_id"), f"{home}/changes", run_id)
        records = merged.drop("changes", "history")
    W.write_table(records, f"{home}/documents", run_id, order=["document_id"])
    documents = W.stored(newest(earlier(spark, home, "documents")))
    if answers is not None:
        documents, checked = N.apply_document_answers(documents, answers, ANSWERABLE)
        documents = W.stored(documents)
        W.write_table(checked.select("document_id", "field", "user_answer", "seq", "state", "error"), f"{home}/answers", run_id)
    documents = documents.withColumn("ord", F.concat_ws("|", "document_id", "scan_ord"))
    treated = C.with_exceptions(C.treatments(C.lineage(documents)))
    matches = W.stored(M.match_tracker(documents.select("proposal_id", "proposal_branch").distinct(), tracker))
    proposals = Y.canonical_identity(documents, Y.matched_rows(matches, tracker), "ord")
    none = documents.limit(0).select(
        F.col("proposal_id").alias("group_id"), F.lit("").alias("field"), F.lit("").alias("scope"), F.lit("").alias("guess"), F.lit(0.0).alias("confidence"),
        F.lit(0).alias("impact"), F.array(F.lit("")).alias("evidence"), F.lit("").alias("reason"), "document_id", F.lit(0).cast("long").alias("ord"),
    )
    decisions = D.consolidate_all(none, D.conflicts(documents, "award_status", matches))
    questions = D.arbitrate(decisions)
    out |= {"documents": documents, "lineage": treated, "proposals": synthesize(proposals, None, ()), "decisions": decisions, "questions": questions}
    for name in ("lineage", "proposals", "decisions", "questions"):
        W.write_table(out[name].drop("summary_short", "summary_detailed") if name == "lineage" else out[name], f"{home}/{name}", run_id)
    counts |= {"described": records.count(), "documents": documents.count(), "questions": questions.count()}
    try:
        K.critical_gate(questions.where("impact > 2"), allow_open)
    except RuntimeError:
        W.write_run_manifest(spark, audit, run_id, 2, "run", "full", "stopped", counts)
        raise
    planned = S.plan_clean_set(documents)
    rows = S.manifest_rows(planned, treated, planned.select("proposal_id", "year_folder", "proposal_branch").distinct())
    out |= {"plan": planned, "exclusions": S.exclusions(documents, found), "manifest": rows}
    for name in ("plan", "exclusions", "manifest"):
        W.write_table(out[name].drop("summary_short", "summary_detailed"), f"{home}/{name}", run_id)
    counts |= {name: out[name].count() for name in ("plan", "exclusions", "manifest")}
    W.write_run_manifest(spark, audit, run_id, 2, "run", "resumed" if before is not None else "full", "done", counts)
    return out
