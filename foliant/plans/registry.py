"""All queries of the archive engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import rules
from foliant.functions import text as T
from foliant.operators import aggregates as A
from foliant.operators import classify as C
from foliant.operators import decisions as D
from foliant.operators import inventory as I
from foliant.operators import tracker as M
from foliant.sources import fixtures as X

KEY_ROLES = (
    "technical_volume", "project_description", "statement_of_work", "commercialization_plan", "award_notice",
    "review_feedback", "budget", "letter_of_support", "biosketch", "evaluation_criteria", "foa", "rfp", "abstract",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


INV = f"WITH {X.INVENTORY_SQL}"


@query("content_ids", f"{INV} SELECT doc_id, document_id, sha256 FROM inventory")
def content_ids(spark, sf):
    return X.inventory(spark, sf).select("doc_id", "document_id", "sha256")


@query("proposal_ids", f"{INV} SELECT doc_id, proposal_id, scan_ord FROM inventory")
def proposal_ids(spark, sf):
    return X.inventory(spark, sf).select("doc_id", "proposal_id", "scan_ord")


SAFE = r"""coalesce(nullif(trim(regexp_replace(regexp_replace(file_name_original, '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '\s+', '_', 'g'), '._'), ''), 'file')"""


@query("safe_file_name", f"{INV} SELECT doc_id, {SAFE} AS safe_name FROM inventory")
def safe_names(spark, sf):
    return X.inventory(spark, sf).select("doc_id", T.safe_file_name(F.col("file_name_original")).alias("safe_name"))


@query(
    "recommended_key",
    f"""{INV} SELECT doc_id, concat_ws('/', 'archive', year_folder, nullif(trim(coalesce(proposal_branch, ''), '/'), ''),
        'documents', {SAFE}) AS key FROM inventory""",
)
def recommended_key(spark, sf):
    parts = (F.lit("/archive/"), F.col("year_folder"), F.coalesce("proposal_branch", F.lit("")), F.lit("documents"))
    return X.inventory(spark, sf).select(
        "doc_id", T.recommended_key(*parts, T.safe_file_name(F.col("file_name_original"))).alias("key")
    )


@query(
    "year_branch_from_path",
    f"{INV} SELECT doc_id, year_folder, proposal_branch FROM inventory WHERE proposal_branch IS NOT NULL",
)
def year_branch(spark, sf):
    return I.in_groups(X.inventory(spark, sf)).select("doc_id", "year_folder", "proposal_branch")


@query(
    "stray_files",
    f"""{INV} SELECT doc_id, relative_path, 'ignored_stray_year_file' AS reason FROM inventory
        WHERE len(string_split(relative_path, '/')) = 2""",
)
def stray(spark, sf):
    return I.stray_files(X.inventory(spark, sf))


@query(
    "drop_hidden_and_temp",
    f"""{INV} SELECT doc_id, relative_path FROM inventory WHERE NOT regexp_matches(relative_path, '(^|/)\\.')
        AND NOT starts_with(file_name_original, '~$')""",
)
def visible(spark, sf):
    return I.drop_temp_office(I.drop_hidden(X.inventory(spark, sf))).select("doc_id", "relative_path")


CLASSED = """
classed AS (SELECT *, extension IN ('.pdf', '.docx', '.doc', '.csv', '.txt', '.md', '.xlsx', '.xls') AS eligible FROM inventory)
"""


@query(
    "classify_files",
    f"""{INV}, {CLASSED} SELECT doc_id, eligible AS eligible_for_processing,
        CASE WHEN extension IN ('.xlsx', '.xls') THEN 'local_extract_then_bedrock' WHEN eligible THEN 'direct_bedrock'
            ELSE 'inventory_only' END AS processing_strategy,
        CASE WHEN eligible THEN 'pending_analysis' ELSE 'inventory_only' END AS processing_status,
        CASE WHEN eligible THEN NULL WHEN extension IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.gif', '.bmp', '.webp')
            THEN 'ignored_image' WHEN extension = '.zip' THEN 'zip_inventory_only'
            WHEN extension IN ('.ppt', '.pptx') THEN 'powerpoint_inventory_only' ELSE 'unsupported_file_type' END AS skip_reason
        FROM classed""",
)
def classify_files(spark, sf):
    return I.classify_files(X.inventory(spark, sf)).select(
        "doc_id", "eligible_for_processing", "processing_strategy", "processing_status", "skip_reason"
    )


@query(
    "choose_strategy",
    f"""{INV} SELECT doc_id, CASE WHEN CASE WHEN extension IN ('.xlsx', '.xls')
            THEN size_bytes / 1048576 <= 0.01 AND doc_id % 5 - 1 BETWEEN 0 AND 3 AND doc_id % 900 <= 500
            ELSE extension IN ('.pdf', '.docx', '.doc', '.csv', '.txt', '.md') AND size_bytes / 1048576 <= 0.02 END
        THEN 'direct_bedrock' ELSE 'local_extract_then_bedrock' END AS effective_strategy FROM inventory""",
)
def choose_strategy(spark, sf):
    inv = X.inventory(spark, sf).withColumns({"sheets": F.col("doc_id") % 5 - 1, "cells": F.col("doc_id") % 900})
    return I.choose_strategy(inv, max_direct_mb=0.02, sheet_mb=0.01).select("doc_id", "effective_strategy")


@query(
    "duplicate_groups",
    f"""{INV} SELECT sha256, count(*) AS copies, arg_min(relative_path, scan_ord) AS first_path,
        arg_max(relative_path, scan_ord) AS kept_path FROM inventory GROUP BY sha256 HAVING count(*) > 1""",
)
def duplicate_groups(spark, sf):
    return I.duplicate_groups(X.inventory(spark, sf))


@query(
    "dedup_content",
    f"""{INV} SELECT document_id, arg_max(doc_id, scan_ord) AS doc_id, arg_max(relative_path, scan_ord) AS relative_path
        FROM inventory GROUP BY document_id""",
)
def dedup_content(spark, sf):
    return I.dedup_content(X.inventory(spark, sf).drop("summary_short", "summary_detailed")).select("document_id", "doc_id", "relative_path")


DECKS = r"""
pdfs AS (SELECT regexp_replace(relative_path, '/[^/]*$', '') AS f, lower(stem) AS s, arg_max(document_id, scan_ord) AS pdf
    FROM inventory WHERE extension = '.pdf' GROUP BY ALL),
decks AS (SELECT i.*, pdf FROM inventory i LEFT JOIN pdfs ON f = regexp_replace(relative_path, '/[^/]*$', '') AND s = lower(stem)
    WHERE extension IN ('.ppt', '.pptx'))
"""


@query(
    "mark_superseded_by_pdf",
    f"{INV}, {DECKS} SELECT doc_id, relative_path, pdf AS superseded_by_document_id FROM decks WHERE pdf IS NOT NULL",
)
def superseded(spark, sf):
    return I.mark_superseded_by_pdf(X.inventory(spark, sf)).where("superseded_by_document_id is not null").select(
        "doc_id", "relative_path", "superseded_by_document_id"
    )


@query(
    "slide_review_questions",
    f"""{INV}, {DECKS} SELECT 'q_' || left(sha256(relative_path), 8) AS question_id, document_id, relative_path,
        'medium' AS priority FROM decks WHERE pdf IS NULL""",
)
def slide_questions(spark, sf):
    return I.slide_questions(X.inventory(spark, sf))


DONE = "doc_id % 3 = 0"


@query(
    "pending_documents",
    f"""{INV}, {CLASSED} SELECT doc_id, document_id FROM classed WHERE eligible
        AND document_id NOT IN (SELECT document_id FROM inventory WHERE {DONE})""",
)
def pending(spark, sf):
    inv = X.inventory(spark, sf)
    return I.pending_documents(inv, inv.where(DONE)).select("doc_id", "document_id")


@query(
    "limit_pending",
    f"""{INV}, {CLASSED} SELECT doc_id, scan_ord FROM classed WHERE eligible
        AND document_id NOT IN (SELECT document_id FROM inventory WHERE {DONE}) ORDER BY scan_ord LIMIT 25""",
)
def limit_pending(spark, sf):
    inv = X.inventory(spark, sf)
    return I.pending_documents(inv, inv.where(DONE), limit=25).select("doc_id", "scan_ord")


@query(
    "resume_status",
    f"""{INV}, {CLASSED}, ids AS (SELECT document_id, bool_or(eligible) AS e FROM classed GROUP BY 1),
        m AS (SELECT e, document_id IN (SELECT document_id FROM inventory WHERE {DONE}) AS d,
            document_id IN (SELECT document_id FROM inventory WHERE doc_id % 7 = 1) AS f FROM ids)
        SELECT count(*) AS total, count(*) FILTER (e) AS eligible, count(*) FILTER (e AND d) AS processed,
        count(*) FILTER (e AND NOT d) AS pending, count(*) FILTER (e AND NOT d AND f) AS failed_pending FROM m""",
)
def resume_status(spark, sf):
    inv = X.inventory(spark, sf)
    return I.resume_status(inv, inv.where(DONE), inv.where("doc_id % 7 = 1"))


#: From a (files with their safe names) to names: each later file tries numbers until one is free.
NAMES = r"""
b AS (SELECT *, row_number() OVER (PARTITION BY proposal_id, safe ORDER BY scan_ord) AS r, regexp_extract(safe, '^(.+?)(\.[^.]*)?$', 1) AS st,
    regexp_extract(safe, '^.+?(\.[^.]*)?$', 1) AS ex FROM a),
l AS (SELECT *, st || '__' || left(sha256, 8) AS h8, row_number() OVER (PARTITION BY proposal_id, st || '__' || left(sha256, 8) || ex ORDER BY scan_ord) AS k
    FROM b WHERE r > 1),
tries AS (SELECT DISTINCT proposal_id, h8, ex, unnest(range(1, 60)) AS t FROM l),
free AS (SELECT *, row_number() OVER (PARTITION BY proposal_id, h8, ex ORDER BY t) AS k FROM (SELECT tries.*, h8 || CASE WHEN t = 1 THEN '' ELSE '_' || t END || ex AS n FROM tries)
    WHERE (proposal_id, n) NOT IN (SELECT (proposal_id, safe) FROM b WHERE r = 1)),
names AS (SELECT b.*, safe AS target_name FROM b WHERE r = 1 UNION ALL
    SELECT b.*, n FROM b JOIN l USING (doc_id) JOIN free ON free.proposal_id = l.proposal_id AND free.h8 = l.h8 AND free.ex = l.ex AND free.k = l.k)
"""


@query(
    "resolve_name_collisions",
    f"{INV}, a AS (SELECT *, {SAFE} AS safe FROM inventory WHERE proposal_branch IS NOT NULL), {NAMES} SELECT doc_id, target_name FROM names",
)
def collisions(spark, sf):
    return I.resolve_name_collisions(X.inventory(spark, sf).where("proposal_branch is not null")).select("doc_id", "target_name")


def _rule_sql(column: str, values, default: str) -> str:
    when = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + f" THEN '{v}'" for words, v in values
    )
    return f"CASE {when} ELSE {default} END"


def _words_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_EXT = "CASE extension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.EXTENSION_CATEGORY.items()) + " ELSE 'unknown' END"
DOCS = f"""
d1 AS (SELECT *, {_rule_sql("stem", rules.CATEGORY_RULES, "NULL")} AS named, {_EXT} AS by_ext,
    {_rule_sql("stem", rules.ROLE_RULES, "'unknown'")} AS document_role,
    {_rule_sql("stem", rules.VERSION_RULES, "'unknown'")} AS version_status,
    {_rule_sql("coalesce(proposal_branch, '')", rules.PROGRAM_RULES, "'unknown'")} AS program,
    {_rule_sql("coalesce(proposal_branch, '')", rules.AGENCY_RULES, "'unknown'")} AS agency,
    {_words_sql("stem", rules.PERSONAL_WORDS)} AS personal FROM inventory),
d2 AS (SELECT *, coalesce(named, by_ext) AS document_category,
    CAST(CASE WHEN named IS NOT NULL THEN 0.45 WHEN by_ext <> 'unknown' THEN 0.35 ELSE 0.30 END AS DOUBLE) AS category_confidence,
    CAST(CASE WHEN document_role = 'unknown' THEN 0.25 ELSE 0.40 END AS DOUBLE) AS role_confidence FROM d1),
d3 AS (SELECT *, document_category = 'budget_financial' OR {_words_sql("stem", rules.BUDGET_WORDS)} AS budget,
    document_category = 'opportunity_document' AND contains(lower(stem), 'evaluation') AS useful,
    document_category = 'opportunity_document' AND NOT contains(lower(stem), 'evaluation') AS boilerplate,
    CASE WHEN document_category = 'opportunity_document' THEN 'source_opportunity'
        WHEN document_category IN ('proposal_response', 'supporting_document') THEN 'generated_response' ELSE 'unknown' END AS origin_type FROM d2),
d4 AS (SELECT *, CASE WHEN budget OR personal THEN 'exclude' WHEN document_role IN {_in(rules.LOW_VALUE_ROLES)} THEN 'low'
        WHEN version_status IN ('superseded', 'draft', 'working_version') THEN 'low'
        WHEN document_role IN {_in(rules.HIGH_VALUE_ROLES)} AND version_status IN ('final', 'submitted_version') THEN 'high'
        ELSE 'medium' END AS rag_priority FROM d3)
"""


@query(
    "classify_documents",
    f"""{INV}, {DOCS} SELECT doc_id, document_category, category_confidence, document_role, role_confidence, version_status,
        origin_type, program, agency, personal AS contains_personal_info, budget AS contains_budget_or_rates,
        useful AS opportunity_context_useful, boilerplate AS boilerplate_heavy, rag_priority FROM d4""",
)
def classify_documents(spark, sf):
    return C.classify_documents(X.inventory(spark, sf)).select(
        "doc_id", "document_category", "category_confidence", "document_role", "role_confidence", "version_status",
        "origin_type", "program", "agency", "contains_personal_info", "contains_budget_or_rates",
        "opportunity_context_useful", "boilerplate_heavy", "rag_priority",
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Classified documents of groups, with labels: low quality is left out of both sets, toxic is personal. What is made of
    texts and hashes is made before the labels are joined, so that texts are shuffled for those only who read them; what
    follows from ids is made after it and isn't shuffled at all."""
    labels = X.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    partners = F.slice(F.split(F.trim("summary_short"), r"[ \t\r\n]+"), 3, 4)
    digits = lambda at: F.conv(F.substring("sha256", at, 2), 16, 10).cast("int")
    made = {"partners": partners, "h": digits(1), "h2": digits(3)}
    labelled = X.contents(spark, sf).withColumns(made).join(labels.hint("merge"), "doc_id", "left")
    out = C.classify_documents(X.files(labelled).where("proposal_branch is not null"))
    keep = ~F.coalesce(F.col("quality") == 0, F.lit(False))
    h, h2 = F.col("h"), F.col("h2")
    out = out.withColumn("contains_personal_info", F.col("contains_personal_info") | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return out.withColumns(
        {
            "include_in_clean_set": keep, "include_in_future_rag": keep, "manual_review_required": F.col("contains_personal_info"),
            "include_reason": F.when(keep & (h2 % 9 != 0), "kept"), "exclude_reason": F.when(~keep & (h % 2 == 0), "low quality"),
            "manual_review_reasons": F.array_compact(F.array(F.when(F.col("contains_personal_info"), "personal information"), F.when(F.col("contains_budget_or_rates"), "budget or rates"))),
            "canonical_proposal_name": F.when(h % 5 == 0, "unknown").when(h % 5 == 1, F.concat("proposal_branch", F.lit(" Study"))).otherwise(F.col("proposal_branch")),
            "status": X.pick(("submitted", "unknown", "awarded", "drafted"), h % 4), "award_status": X.pick(("unknown", "", "selected", "declined"), h2 % 4),
            "submission_date": F.when(h2 % 3 != 0, F.concat(F.lit("2024-01-"), F.lpad((1 + h % 28).cast("string"), 2, "0"))),
            "lead_organization": F.when(h % 6 != 0, F.concat(F.lit("Org "), (h2 % 5).cast("string"))),
            "name_confidence": h2 / 256.0, "rag_confidence": h / 256.0, "reviewed_twice": h2 % 7 == 0,
            "ord": F.concat_ws("|", "document_id", "scan_ord"),
        }
    )


LABELLED = f"""{INV}, {DOCS},
docs AS (SELECT d4.* EXCLUDE (personal), personal OR coalesce(toxic = 1, false) AS personal, NOT coalesce(quality = 0, false) AS keep,
    CAST('0x' || sha256[1:2] AS INTEGER) AS h, CAST('0x' || sha256[3:4] AS INTEGER) AS h2,
    CASE WHEN NOT coalesce(quality = 0, false) AND h2 % 9 <> 0 THEN 'kept' END AS include_reason,
    CASE WHEN quality = 0 AND h % 2 = 0 THEN 'low quality' END AS exclude_reason,
    concat_ws('; ', CASE WHEN d4.personal OR coalesce(toxic = 1, false) THEN 'personal information' END, CASE WHEN budget THEN 'budget or rates' END) AS review_reasons,
    CASE h % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN proposal_branch || ' Study' ELSE proposal_branch END AS canonical_proposal_name,
    ['submitted', 'unknown', 'awarded', 'drafted'][h % 4 + 1] AS status, ['unknown', '', 'selected', 'declined'][h2 % 4 + 1] AS award_status,
    CASE WHEN h2 % 3 <> 0 THEN '2024-01-' || lpad(CAST(1 + h % 28 AS VARCHAR), 2, '0') END AS submission_date,
    CASE WHEN h % 6 <> 0 THEN 'Org ' || h2 % 5 END AS lead_organization, h2 / 256.0::DOUBLE AS name_confidence, h / 256.0::DOUBLE AS rag_confidence,
    h2 % 7 = 0 AS reviewed_twice, string_split_regex(trim(summary_short), '[ \t\r\n]+')[3:6] AS partners, document_id || '|' || scan_ord AS ord,
    CASE WHEN version_status = 'superseded' THEN 'superseded' WHEN version_status IN ('final', 'submitted_version') THEN 'authoritative'
        WHEN coalesce(quality = 0, false) THEN 'excluded' ELSE 'supporting' END AS authority_rank
    FROM d4 LEFT JOIN labels USING (doc_id) WHERE proposal_branch IS NOT NULL),
best AS (SELECT proposal_id, document_role, min(document_id) AS f, list(DISTINCT summary_detailed) AS details
    FROM docs WHERE authority_rank = 'authoritative' GROUP BY ALL),
lin AS (SELECT docs.*, CASE WHEN authority_rank <> 'authoritative' THEN f END AS superseded_by_document_id,
    coalesce(authority_rank <> 'authoritative' AND f IS NOT NULL AND summary_detailed <> '' AND NOT list_contains(details, summary_detailed), false)
        AS contains_unique_reasoning FROM docs LEFT JOIN best USING (proposal_id, document_role))
"""


@query(
    "lineage",
    f"{LABELLED} SELECT doc_id, authority_rank, superseded_by_document_id, contains_unique_reasoning FROM lin",
)
def lineage(spark, sf):
    return C.lineage(documents(spark, sf)).select(
        "doc_id", "authority_rank", "superseded_by_document_id",
        F.coalesce("contains_unique_reasoning", F.lit(False)).alias("contains_unique_reasoning"),
    )


@query(
    "knowledge_base_treatment",
    f"""{LABELLED} SELECT doc_id, CASE WHEN authority_rank = 'superseded' THEN 'superseded_low_priority'
            WHEN authority_rank = 'supporting' AND version_status IN ('draft', 'working_version') THEN 'draft_retained_for_unique_reasoning'
            WHEN document_role IN {_in(rules.HIGH_VALUE_ROLES)} THEN 'high_value_roles'
            WHEN document_role IN {_in(rules.LOW_VALUE_ROLES)} AND useful THEN 'evaluation_criteria_may_be_useful'
            WHEN document_role IN {_in(rules.LOW_VALUE_ROLES)} THEN 'opportunity_boilerplate_not_high_value'
            WHEN budget OR personal THEN 'budgets_excluded_from_rag' END AS policy_applied,
        CASE WHEN budget OR personal THEN 'exclude' WHEN useful THEN 'summary_only' WHEN boilerplate THEN 'metadata_only'
            WHEN rag_priority = 'high' THEN 'full_document' WHEN rag_priority = 'medium' THEN 'summary_only'
            WHEN rag_priority = 'low' THEN 'metadata_only' ELSE 'exclude' END AS recommended_treatment FROM lin""",
)
def treatment(spark, sf):
    return C.treatments(C.lineage(documents(spark, sf))).select("doc_id", "policy_applied", "recommended_treatment")


_ORDER = "CASE document_role " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(KEY_ROLES)) + f" ELSE {len(KEY_ROLES)} END"


@query(
    "key_documents",
    f"""{LABELLED}, r AS (SELECT *, {_ORDER} AS o, row_number() OVER (PARTITION BY proposal_id, document_role
            ORDER BY authority_rank <> 'authoritative', document_id, doc_id) AS n FROM lin),
        p AS (SELECT *, CASE WHEN o < {len(KEY_ROLES)} AND n = 1 THEN 0 WHEN rag_priority = 'high' THEN 1 END AS band FROM r),
        q AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY band, CASE WHEN band = 0 THEN o END NULLS FIRST, document_id) AS key_rank
            FROM p WHERE band IS NOT NULL)
        SELECT proposal_id, document_id, document_role, CAST(key_rank AS INTEGER) AS key_rank FROM q WHERE key_rank <= 10""",
)
def key_documents(spark, sf):
    return C.key_documents(C.lineage(documents(spark, sf)), KEY_ROLES)


VOTE = """
v AS (SELECT proposal_id, document_category AS v, count(*) AS n, min(document_id) AS o FROM docs
    WHERE document_category NOT IN ('', 'unknown') GROUP BY ALL),
m AS (SELECT proposal_id, max(n) AS n FROM v GROUP BY 1)
"""


@query(
    "consensus",
    f"""{LABELLED}, {VOTE}, t AS (SELECT v.proposal_id, m.n, count(*) AS ties, min(v.v) AS v FROM v JOIN m ON v.proposal_id = m.proposal_id AND v.n = m.n GROUP BY ALL)
        SELECT proposal_id, CASE WHEN ties = 1 THEN v ELSE 'unknown' END AS document_category, coalesce(n, 0) AS n_votes
        FROM (SELECT DISTINCT proposal_id FROM docs) LEFT JOIN t USING (proposal_id)""",
)
def consensus(spark, sf):
    return A.consensus(documents(spark, sf), "proposal_id", "document_category", "document_id")


@query(
    "most_common_known",
    f"""{LABELLED}, {VOTE} SELECT proposal_id, v AS document_category FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id
        ORDER BY n DESC, o, v) AS r FROM v) WHERE r = 1""",
)
def most_common(spark, sf):
    return A.most_common_known(documents(spark, sf), "proposal_id", "document_category", "document_id")


@query(
    "first_non_null",
    f"""{LABELLED} SELECT proposal_id, arg_min(summary_short, document_id || '|' || scan_ord) AS summary_short FROM docs
        WHERE summary_short IS NOT NULL GROUP BY 1""",
)
def first_non_null(spark, sf):
    docs = documents(spark, sf).withColumn("o", F.concat_ws("|", "document_id", "scan_ord"))
    return A.first_non_null(docs, "proposal_id", "summary_short", "o")


@query(
    "ordered_union",
    f"""{LABELLED}, w AS (SELECT proposal_id, document_id || '|' || scan_ord AS o, string_split(trim(summary_short), ' ') AS l FROM docs),
        e AS (SELECT proposal_id, o, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS item FROM w),
        f AS (SELECT proposal_id, item, min(struct_pack(o := o, p := p)) AS pos FROM e WHERE trim(item) <> '' GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY pos) AS n FROM f)
        SELECT proposal_id, string_agg(item, '|' ORDER BY n) AS items FROM r WHERE n <= 12 GROUP BY 1""",
)
def ordered_union(spark, sf):
    docs = documents(spark, sf).withColumn("o", F.concat_ws("|", "document_id", "scan_ord")).withColumn(
        "items", F.split(F.trim("summary_short"), " ")
    )
    return A.ordered_union(docs, "proposal_id", "items", "o", 12).select("proposal_id", F.array_join("items", "|").alias("items"))


@query(
    "counter_map",
    f"""{LABELLED}, n AS (SELECT proposal_id, document_role AS r, count(*) AS n FROM docs GROUP BY ALL)
        SELECT proposal_id, string_agg(r || '=' || n, ',' ORDER BY r) AS counts FROM n GROUP BY 1""",
)
def counter_map(spark, sf):
    counted = A.counter_map(documents(spark, sf), "proposal_id", "document_role")
    shown = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return counted.select("proposal_id", F.array_join(shown, ",").alias("counts"))


@query(
    "match_tracker",
    f"""{INV}, {X.TRACKER_SQL},
        h AS (SELECT DISTINCT proposal_id, list_distinct(list_filter(string_split_regex(lower(proposal_branch), '[^a-z0-9]+'), lambda t: length(t) > 1)) AS ht
            FROM inventory WHERE proposal_branch IS NOT NULL),
        t AS (SELECT row_id, list_distinct(list_filter(string_split_regex(lower(proposal_name), '[^a-z0-9]+'), lambda t: length(t) > 1)) AS rt FROM tracker),
        s AS (SELECT proposal_id, row_id, len(list_intersect(ht, rt)) / (len(ht) + len(rt) - len(list_intersect(ht, rt))) AS score FROM h, t),
        b AS (SELECT proposal_id, max(score) AS best FROM s WHERE score > 0 GROUP BY 1),
        k AS (SELECT s.proposal_id, any_value(best) AS best, count(*) AS n, arg_min(row_id, struct_pack(a := -score, b := row_id)) AS top
            FROM s JOIN b ON b.proposal_id = s.proposal_id AND best - score < 0.05 AND score > 0 GROUP BY 1)
        SELECT h.proposal_id, CASE WHEN coalesce(best, 0) < 0.35 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status,
            coalesce(best, 0.0) AS confidence, CASE WHEN coalesce(best, 0) < 0.35 THEN 0 ELSE n END AS n_candidates,
            CASE WHEN coalesce(best, 0) >= 0.35 AND n = 1 THEN top END AS row_id
        FROM (SELECT DISTINCT proposal_id FROM h) h LEFT JOIN k USING (proposal_id)""",
)
def match_tracker(spark, sf):
    groups = X.inventory(spark, sf).where("proposal_branch is not null").select("proposal_id", "proposal_branch").distinct()
    return M.match_tracker(groups, X.tracker(spark, sf)).drop("candidate_row_ids")


DECIDED = f"""WITH {X.UNCERTAIN_SQL},
keyed AS (SELECT *, lower(trim(string_split(field, '.')[-1])) AS field_key FROM unc),
main AS (SELECT group_id, field_key, arg_min(field, ord) AS field, arg_max(guess, struct_pack(c := confidence, o := -ord)) AS guess,
    max(confidence) AS confidence, max(impact) AS impact, count(*) AS sources FROM keyed GROUP BY 1, 2),
ev AS (SELECT group_id, field_key, ord, unnest([1, 2]) AS p, unnest(evidence) AS item FROM keyed),
ev1 AS (SELECT group_id, field_key, item, min(struct_pack(o := ord, p := p)) AS pos FROM ev GROUP BY ALL),
ev2 AS (SELECT group_id, field_key, string_agg(item, '|' ORDER BY pos) AS evidence FROM ev1 GROUP BY 1, 2),
dec AS (SELECT main.*, evidence, 'q_' || left(sha256(group_id || '|proposal|confirm|' || field_key), 12) AS question_id
    FROM main JOIN ev2 USING (group_id, field_key))
"""


def decisions(spark, sf):
    return D.consolidate(X.uncertainties(spark, sf))


@query(
    "consolidate_decisions",
    f"{DECIDED} SELECT group_id, field_key, field, guess, confidence, impact, sources, evidence, question_id FROM dec",
)
def consolidate(spark, sf):
    return decisions(spark, sf)


@query(
    "arbitrate",
    f"""{DECIDED}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY impact DESC, question_id) AS group_rank FROM dec WHERE impact > 0)
        SELECT group_id, question_id, impact, CAST(group_rank AS INTEGER) AS group_rank FROM r WHERE group_rank <= 3
        ORDER BY impact DESC, group_id, question_id LIMIT 20""",
)
def arbitrate(spark, sf):
    return D.arbitrate(decisions(spark, sf)).select("group_id", "question_id", "impact", "group_rank")


@query(
    "arbitration_counts",
    f"""{DECIDED}, g AS (SELECT group_id, count(*) AS n, count(*) FILTER (impact = 0) AS low FROM dec GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(low) AS BIGINT) AS low, CAST(least(sum(least(n - low, 3)), 20) AS BIGINT) AS exported,
            CAST(sum(n) - least(sum(least(n - low, 3)), 20) AS BIGINT) AS suppressed FROM g""",
)
def arbitration_counts(spark, sf):
    return D.arbitration_counts(decisions(spark, sf))


OVERRIDES = """
ovr AS (SELECT group_id, field_key, arg_max(guess, ord) AS applied_value, max(ord) AS seq FROM keyed
    WHERE event_type = 'purchase' OR ord % 5 = 0 GROUP BY 1, 2)
"""


def overrides(spark, sf):
    log = X.uncertainties(spark, sf).where("event_type = 'purchase' or ord % 5 = 0").select(
        "group_id", D.canonical_field("field").alias("field_key"), F.col("guess").alias("applied_value"), F.col("ord").alias("seq")
    )
    return D.latest_override(log, "group_id", "field_key")


@query("latest_override", f"{DECIDED}, {OVERRIDES} SELECT * FROM ovr")
def latest_override(spark, sf):
    return overrides(spark, sf)


@query(
    "resolve_by_override",
    f"""{DECIDED}, {OVERRIDES} SELECT question_id, guess, applied_value, CASE WHEN applied_value IS NULL THEN 'open'
        WHEN guess IS NULL OR guess = applied_value THEN 'resolved' ELSE 'reopened' END AS resolution
        FROM dec LEFT JOIN ovr USING (group_id, field_key)""",
)
def resolve(spark, sf):
    return D.resolve_by_override(decisions(spark, sf), overrides(spark, sf)).select(
        "question_id", "guess", "applied_value", "resolution"
    )


USAGE = """WITH u0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
u AS (SELECT event_id, user_id, ts, 1 + event_id % 2 AS pass_number, event_type <> 'error' AS success,
    CASE WHEN k <> 0 THEN k * 100 END AS total_tokens, value / 1000 AS latency, event_type = 'error' AND k >= 90 AS is_quota FROM u0)
"""


def usage(spark, sf):
    return D.usage_rows(X.table(spark, sf, "events"))


@query(
    "usage_by_stage",
    f"""{USAGE} SELECT pass_number, success, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens, max(latency) AS max_latency
        FROM u GROUP BY ROLLUP (pass_number, success)""",
)
def usage_by_stage(spark, sf):
    return D.usage_by_stage(usage(spark, sf))


@query(
    "usage_merge",
    f"{USAGE} SELECT user_id, pass_number, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM u GROUP BY 1, 2",
)
def usage_merge(spark, sf):
    return D.usage_merge(usage(spark, sf))


@query(
    "run_report",
    f"""{USAGE} SELECT 'pass' AS dimension, CAST(pass_number AS VARCHAR) AS value, count(*) AS n FROM u GROUP BY 2
        UNION ALL SELECT 'success', CAST(success AS VARCHAR), count(*) FROM u GROUP BY 2
        UNION ALL SELECT 'quota', CAST(is_quota AS VARCHAR), count(*) FROM u GROUP BY 2""",
)
def run_report(spark, sf):
    return D.run_report(usage(spark, sf))


@query(
    "halt_on_quota",
    f"""{USAGE}, r AS (SELECT *, coalesce(bool_or(is_quota) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS halted FROM u)
        SELECT event_id, user_id, is_quota FROM r WHERE NOT halted""",
)
def halt_on_quota(spark, sf):
    return D.halt_on_quota(usage(spark, sf)).select("event_id", "user_id", "is_quota")


@query(
    "usage_per_day",
    f"""{USAGE} SELECT date_trunc('day', ts) AS day, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS calls,
        count(*) FILTER (NOT success) AS failures FROM u GROUP BY 1""",
)
def usage_per_day(spark, sf):
    from foliant.streaming.jobs import usage_per_day as per_day

    return per_day(usage(spark, sf)).select(F.col("day").cast("timestamp_ntz").alias("day"), "tokens", "calls", "failures")


def queries() -> dict:
    import foliant.plans.records  # noqa: F401  (adds its queries, as does review, which it imports)
    import foliant.plans.folders  # noqa: F401
    import foliant.plans.runs  # noqa: F401
    import foliant.plans.scoring  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLES
