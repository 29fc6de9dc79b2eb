"""Rule-based document classifier, and what follows from its labels: authority, policies, treatment, key documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant import rules
from foliant.functions.text import any_word, first_rule


def classify_documents(inventory: DataFrame) -> DataFrame:
    """Adds category, role, version, origin, program, agency, sensitivity and retrieval priority with confidences. One
    projection of compiled rules."""
    stem = F.col("stem")
    by_ext = F.lit("unknown")
    for ext, value in rules.EXTENSION_CATEGORY.items():
        by_ext = F.when(F.col("extension") == ext, value).otherwise(by_ext)
    named = first_rule(stem, rules.CATEGORY_RULES, None)
    out = inventory.withColumns(
        {
            "document_category": F.coalesce(named, by_ext),
            "category_confidence": F.when(named.isNotNull(), 0.45).when(by_ext != "unknown", 0.35).otherwise(0.30),
            "document_role": first_rule(stem, rules.ROLE_RULES, "unknown"),
            "version_status": first_rule(stem, rules.VERSION_RULES, "unknown"),
            "program": first_rule(F.coalesce("proposal_branch", F.lit("")), rules.PROGRAM_RULES, "unknown"),
            "agency": first_rule(F.coalesce("proposal_branch", F.lit("")), rules.AGENCY_RULES, "unknown"),
            "contains_personal_info": any_word(stem, rules.PERSONAL_WORDS),
        }
    )
    category = F.col("document_category")
    opportunity = category == "opportunity_document"
    useful = opportunity & F.lower("stem").contains("evaluation")
    out = out.withColumns(
        {
            "role_confidence": F.when(F.col("document_role") == "unknown", 0.25).otherwise(0.40),
            "origin_type": F.when(opportunity, "source_opportunity")
            .when(category.isin("proposal_response", "supporting_document"), "generated_response")
            .otherwise("unknown"),
            "contains_budget_or_rates": (category == "budget_financial") | any_word(stem, rules.BUDGET_WORDS),
            "opportunity_context_useful": useful,
            "boilerplate_heavy": opportunity & ~useful,
            "opportunity_treatment": F.when(useful, "summary_only").when(opportunity, "metadata_only"),
        }
    )
    version, role = F.col("version_status"), F.col("document_role")
    sensitive = F.col("contains_budget_or_rates") | F.col("contains_personal_info")
    priority = (
        F.when(sensitive, "exclude").when(role.isin(*rules.LOW_VALUE_ROLES), "low").when(version == "superseded", "low")
        .when(version.isin("draft", "working_version"), "low")
        .when(role.isin(*rules.HIGH_VALUE_ROLES) & version.isin("final", "submitted_version"), "high").otherwise("medium")
    )
    return out.withColumns({"rag_priority": priority, "manual_review_required": F.col("contains_personal_info")})


# How sure the rules are of what they don't read from a name, and of what follows from it.
UNSURE, FAIRLY_SURE = 0.30, 0.45
UNSURE_OF = ("origin_type", "version_status", "agency", "program", "status", "award_status")
FAIRLY_SURE_OF = ("canonical_proposal_name", "include_in_clean_set", "include_in_future_rag", "rag_priority")
#: Note on records that rules made, not a model.
BY_RULES = "generated_by: rules"


def version_evidence(stem: Column) -> Column:
    """The word of a file name that its version follows from: of the first rule that fits its first word."""
    lower, out = F.lower(stem), F.lit("The file name has no word for a version.")
    for words, _ in reversed(rules.VERSION_RULES):
        for word in reversed(words):
            out = F.when(lower.contains(word), f"The file name has '{word}'.").otherwise(out)
    return out


def with_records(classified: DataFrame) -> DataFrame:
    """Classified files (with eligible_for_processing) as whole records: the confidences of all values, what the version
    follows from, inclusion with its reasons, identity as far as paths tell it."""
    eligible, sensitive = F.col("eligible_for_processing"), F.col("rag_priority") == "exclude"
    blank = lambda kind: F.lit(None).cast(kind)
    return classified.withColumns(
        {f"{c}_confidence": F.lit(UNSURE) for c in UNSURE_OF} | {f"{c}_confidence": F.lit(FAIRLY_SURE) for c in FAIRLY_SURE_OF}
        | {
            "document_category_confidence": F.col("category_confidence"), "document_role_confidence": F.col("role_confidence"),
            "draft_or_final_evidence": version_evidence(F.col("stem")), "canonical_document_title": F.col("stem"), "language": F.lit("unknown"),
            "canonical_proposal_name": F.col("proposal_branch"), "status": F.lit("unknown"), "award_status": F.lit("unknown"),
            "submission_date": blank("string"), "lead_organization": blank("string"), "partners": F.array().cast("array<string>"),
            "include_in_clean_set": eligible, "include_in_future_rag": eligible & ~sensitive,
            "include_reason": F.when(eligible, "Files of this kind are processed."), "exclude_reason": F.when(~eligible, "Files of this kind are not processed."),
            "manual_review_reasons": F.array_compact(F.array(F.when(F.col("contains_personal_info"), "personal information"))),
            "uncertainties": F.array().cast("array<string>"), "processing_notes": F.array(F.lit(BY_RULES)),
            # Labels.
            "sensitivity_labels": F.array_compact(F.array(F.when(F.col("contains_budget_or_rates"), "financial_sensitive"), F.when(F.col("contains_personal_info"), "personal_info"))),
            "useful_context_summary": F.when(F.col("opportunity_context_useful"), "Its name says that it tells how proposals are judged."),
            "boilerplate_summary": F.when(F.col("boilerplate_heavy"), "A general text of an opportunity."),
        }
    )


def authority_rank() -> Column:
    """Superseded, then final or submitted, then left out of both sets, then supporting."""
    return (
        F.when(F.col("version_status") == "superseded", "superseded")
        .when(F.col("version_status").isin("final", "submitted_version"), "authoritative")
        .when(~F.col("include_in_clean_set") & ~F.col("include_in_future_rag"), "excluded")
        .otherwise("supporting")
    )


def lineage(documents: DataFrame) -> DataFrame:
    """Adds authority_rank, superseded_by_document_id (first authoritative document of the role) and
    contains_unique_reasoning (its detail is in none of them). Grouped by group and role, joined back: no document is
    compared with each other one, and details meet by their hash."""
    detail = F.trim("summary_detailed")
    ranked = documents.withColumns({"authority_rank": authority_rank(), "_detail": F.md5(detail), "_told": detail != ""})
    top = ranked.where("authority_rank = 'authoritative'")
    best = top.groupBy("proposal_id", "document_role").agg(F.min("document_id").alias("_first"))
    said = top.select("proposal_id", "document_role", "_detail").distinct().withColumn("_said", F.lit(True))
    joined = ranked.join(best.hint("merge"), ["proposal_id", "document_role"], "left").join(
        said.hint("merge"), ["proposal_id", "document_role", "_detail"], "left"
    )
    follows = (F.col("authority_rank") != "authoritative") & F.col("_first").isNotNull()
    return joined.withColumns(
        {
            "superseded_by_document_id": F.when(follows, F.col("_first")),
            "contains_unique_reasoning": follows & F.col("_told") & F.col("_said").isNull(),
        }
    ).drop("_first", "_detail", "_said", "_told")


def treatments(with_lineage: DataFrame) -> DataFrame:
    """Adds policy_applied and recommended_treatment; sensitive documents are always excluded."""
    role, rank = F.col("document_role"), F.col("authority_rank")
    sensitive = F.col("contains_budget_or_rates") | F.col("contains_personal_info")
    policy = (
        F.when(rank == "superseded", "superseded_low_priority")
        .when((rank == "supporting") & F.col("version_status").isin("draft", "working_version"), "draft_retained_for_unique_reasoning")
        .when(role.isin(*rules.HIGH_VALUE_ROLES), "high_value_roles")
        .when(role.isin(*rules.LOW_VALUE_ROLES) & F.col("opportunity_context_useful"), "evaluation_criteria_may_be_useful")
        .when(role.isin(*rules.LOW_VALUE_ROLES), "opportunity_boilerplate_not_high_value")
        .when((F.col("document_category") == "budget_financial") | sensitive, "budgets_excluded_from_rag")
    )
    by_priority = F.lit("metadata_only")
    for priority, value in rules.TREATMENT_BY_PRIORITY.items():
        by_priority = F.when(F.col("rag_priority") == priority, value).otherwise(by_priority)
    own = F.col("opportunity_context_useful") | F.col("boilerplate_heavy")
    return with_lineage.withColumns(
        {
            "policy_applied": policy,
            "recommended_treatment": F.when(sensitive, "exclude").when(own, F.col("opportunity_treatment")).otherwise(by_priority),
        }
    )


#: What a document holds that lets it be treated otherwise than its policy says, by policy.
EXCEPTIONS = {
    "superseded_low_priority": "It was replaced, but holds reasoning that the leading version lacks.",
    "draft_retained_for_unique_reasoning": "A draft, kept since it holds reasoning that the leading version lacks.",
    "evaluation_criteria_may_be_useful": "Its role is seldom useful, but this one says how proposals are judged.",
}


def with_exceptions(treated: DataFrame) -> DataFrame:
    """Adds exception_reason: why a document is an exception from the policy applied to it; null if it is none."""
    unique = F.coalesce("contains_unique_reasoning", F.lit(False))
    why = F.lit(None).cast("string")
    for policy, reason in EXCEPTIONS.items():
        holds = F.col("policy_applied") == policy
        why = F.when(holds if policy.startswith("evaluation") else holds & unique, reason).otherwise(why)
    return treated.withColumn("exception_reason", why)


def key_documents(with_lineage: DataFrame, roles: tuple[str, ...], cap: int = 10) -> DataFrame:
    """The best document of each listed role of a group (authoritative ones first, then by id), then other documents of
    high priority, `cap` in all."""
    order = F.lit(len(roles))
    for i, role in enumerate(roles):
        order = F.when(F.col("document_role") == role, i).otherwise(order)
    best = Window.partitionBy("proposal_id", "document_role").orderBy((F.col("authority_rank") != "authoritative"), "document_id")
    ranked = with_lineage.withColumn("_o", order).withColumn("_n", F.row_number().over(best))
    picked = ranked.withColumn("_band", F.when((F.col("_o") < len(roles)) & (F.col("_n") == 1), 0).when(F.col("rag_priority") == "high", 1))
    inside = Window.partitionBy("proposal_id").orderBy("_band", F.when(F.col("_band") == 0, F.col("_o")), "document_id")
    return (
        picked.where("_band is not null").withColumn("key_rank", F.row_number().over(inside)).where(F.col("key_rank") <= cap)
        .select("proposal_id", "document_id", "document_role", "key_rank")
    )
