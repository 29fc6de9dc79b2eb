"""Queries of responses, second passes, roll-ups and the clean set, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import rules
from foliant.functions import text as T
from foliant.operators import classify as C
from foliant.operators import clean_set as S
from foliant.operators import inventory as I
from foliant.operators import responses as R
from foliant.operators import second_pass as P
from foliant.plans.registry import CLASSED, INV, LABELLED, NAMES, SAFE, _in, documents, query
from foliant.sources import fixtures as X

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    "quota_errors",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT event_id, event_type = 'error' AND k >= 90 AS quota FROM e""",
)
def quota_errors(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    why = F.when(k >= 90, "ThrottlingException: Too many tokens per day").otherwise("ThrottlingException: slow down")
    events = X.table(spark, sf, "events").withColumn("message", F.when(F.col("event_type") == "error", why))
    return events.select("event_id", T.quota_error(F.col("message")).alias("quota"))


@query(
    "safe_doc_title",
    rf"""{INV} SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(
        regexp_replace(file_name_original, '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9\-()\[\] ]+', ' ', 'g'), '\s+', ' ', 'g')), ''), 'document') AS title
        FROM inventory""",
)
def safe_doc_title(spark, sf):
    return X.inventory(spark, sf).select("doc_id", T.safe_doc_title(F.col("file_name_original")).alias("title"))


@query(
    "request_text",
    rf"""WITH b AS (SELECT doc_id, {STRIP.format("coalesce(text, '')")} AS b FROM documents)
        SELECT doc_id, CASE WHEN b = '' THEN '(no text)' WHEN length(b) > 200000 THEN '[Cut from ' || length(b) || ' to 200000 characters]' || chr(10) || chr(10)
            || regexp_replace(left(b, 200000), '\s+$', '') ELSE b END AS payload FROM b""",
)
def request_text(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.request_text(F.col("text"), 200_000).alias("payload"))


@query(
    "page_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
        '[ \t\r\n\f]+', ' ', 'g')) AS text FROM pages""",
)
def page_text(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.page_text(F.col("html")).alias("text"))


_CATEGORY = ("Budget", "budget_spreadsheet", "proposal_response", "Opportunity Source", "novel")
_ROLE = ("Partner Support Letter", "budget", "technical_volume", "FOA instructions")
_PROGRAM = ("SBIR Phase I", "sttr-2", "FOA 12", "BAA", "Grand Prize", "unknown")
_STATUS = ("in progress", "Under Review", "awarded")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """A model response for each document: plain, fenced, inside a remark, in a list, or broken off."""
    d = F.col("doc_id")
    inner = F.format_string(
        '{"document_category": "%s", "document_role": "%s"}', X.pick(_CATEGORY, d % 5), X.pick(_ROLE, d % 4)
    )
    body = F.format_string(
        '{"document_identity": %s, "proposal_context": {"program": "%s", "status": "%s"}, "confidence": {"document_category": %s}}',
        inner, X.pick(_PROGRAM, d % 6), X.pick(_STATUS, d % 3), F.when(d % 17 == 0, "1.5").otherwise(F.concat(F.lit("0."), d % 10)),
    )
    raw = (
        F.when(d % 11 == 0, F.expr("left(body, length(body) - 1)")).when(d % 13 == 0, F.concat(F.lit("["), body, F.lit("]")))
        .when(d % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(d % 5 == 2, F.concat(F.lit("Here: { it is "), body, F.lit(" done"))).otherwise(F.col("body"))
    )
    return X.table(spark, sf, "documents").select("doc_id", body.alias("body")).select("doc_id", raw.alias("raw_text"))


RESPONSES = f"""WITH parts AS (SELECT doc_id, '{{"document_category": "' || {X._list(_CATEGORY)}[doc_id % 5 + 1] || '", "document_role": "' ||
    {X._list(_ROLE)}[doc_id % 4 + 1] || '"}}' AS inn, '"program": "' || {X._list(_PROGRAM)}[doc_id % 6 + 1] || '", "status": "' || {X._list(_STATUS)}[doc_id % 3 + 1]
    || '"' AS ctx, CASE WHEN doc_id % 17 = 0 THEN '1.5' ELSE '0.' || doc_id % 10 END AS conf FROM documents),
full_body AS (SELECT *, '{{"document_identity": ' || inn || ', "proposal_context": {{' || ctx || '}}, "confidence": {{"document_category": ' || conf || '}}}}' AS b FROM parts),
resp AS (SELECT *, doc_id % 11 = 0 AS broken, doc_id % 13 = 0 AS listed, doc_id % 3 = 1 AS fenced, doc_id % 5 = 2 AS remark FROM full_body),
strict AS (SELECT *, CASE WHEN NOT broken AND NOT listed AND (fenced OR NOT remark) THEN b END AS body,
    CASE WHEN broken THEN left(b, length(b) - 1) WHEN listed THEN '[' || b || ']' WHEN fenced THEN '```json' || chr(10) || b || chr(10) || '```'
        WHEN remark THEN 'Here: {{ it is ' || b || ' done' ELSE b END AS raw_text FROM resp),
lenient AS (SELECT * EXCLUDE (body), CASE WHEN broken THEN inn ELSE b END AS body FROM strict),
fields AS (SELECT doc_id, broken, raw_text, CASE WHEN broken THEN NULL ELSE {["budget_financial", "budget_financial", "proposal_response", "opportunity_document", "novel"]}[doc_id % 5 + 1] END AS document_category,
    CASE WHEN broken THEN NULL ELSE {["letter_of_support", "budget", "technical_volume", "submission_instructions"]}[doc_id % 4 + 1] END AS document_role,
    CASE WHEN broken THEN NULL ELSE {["SBIR", "STTR", "FOA", "BAA", "Grand Prize", "unknown"]}[doc_id % 6 + 1] END AS program,
    CASE WHEN broken THEN NULL ELSE {["active", "pending", "awarded"]}[doc_id % 3 + 1] END AS status,
    CASE WHEN broken THEN NULL ELSE CAST(conf AS DOUBLE) END AS confidence FROM lenient),
bad AS (SELECT *, concat_ws(',', CASE WHEN coalesce(document_category, 'novel') = 'novel' THEN 'document_category' END,
    CASE WHEN confidence IS NULL OR confidence > 1 THEN 'confidence' END) AS details FROM fields)
"""


@query("parse_response_strict", f"{RESPONSES} SELECT doc_id, body FROM strict")
def parse_strict(spark, sf):
    return R.parse_strict(responses(spark, sf)).select("doc_id", "body")


@query("parse_response_lenient", f"{RESPONSES} SELECT doc_id, body FROM lenient")
def parse_lenient(spark, sf):
    return R.parse_lenient(responses(spark, sf)).select("doc_id", "body")


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return R.response_fields(R.parse_lenient(responses(spark, sf)))


@query(
    "normalize_responses",
    f"{RESPONSES} SELECT doc_id, document_category, document_role, program, status, confidence FROM fields WHERE NOT broken",
)
def normalize(spark, sf):
    found = fields(spark, sf).where("confidence is not null")
    return found.select("doc_id", "document_category", "document_role", "program", "status", "confidence")


@query("valid_responses", f"{RESPONSES} SELECT doc_id, document_category, confidence FROM bad WHERE details = ''")
def valid(spark, sf):
    return R.validate(fields(spark, sf), R.response_checks())[0].select("doc_id", "document_category", "confidence")


@query(
    "response_failures",
    f"""{RESPONSES} SELECT doc_id, string_split(details, ',')[1] AS error_type, details, left(raw_text, 500) AS preview
        FROM bad WHERE details <> ''""",
)
def response_failures(spark, sf):
    return R.failures(R.validate(fields(spark, sf), R.response_checks())[1]).select("doc_id", "error_type", "details", "preview")


@query(
    "needs_review_pass2",
    f"""{LABELLED} SELECT doc_id, NOT reviewed_twice AND (category_confidence < 0.36 OR role_confidence < 0.36 OR rag_confidence < 0.36
        OR origin_type = 'unknown' OR canonical_proposal_name = 'unknown' OR personal) AS needed FROM docs""",
)
def needs_review(spark, sf):
    return documents(spark, sf).select("doc_id", P.needs_review(0.36, [F.col("contains_personal_info")]).alias("needed"))


PAIRS = (("document_category", "category_confidence"), ("document_role", "role_confidence"))


def second_look(first: DataFrame) -> DataFrame:
    """A second opinion for each document: the same, a letter, an unknown category, or a doubtful role."""
    m = F.col("doc_id") % 4
    sure = lambda c: F.when(m == 3, 0.1).otherwise(c)
    return first.select(
        "doc_id",
        F.when(m == 2, "unknown").when(m == 1, "partner_document").otherwise(F.col("document_category")).alias("document_category"),
        sure(0.92).alias("category_confidence"),
        F.when(m == 1, "letter_of_support").when(m == 3, "rfp").otherwise(F.col("document_role")).alias("document_role"),
        sure(0.95).alias("role_confidence"), (F.col("doc_id") % 3 == 0).alias("explained"), F.lit("second look").alias("reason"),
    )


MERGED = f"""{LABELLED},
p AS (SELECT doc_id, document_category AS a, category_confidence AS ac, document_role AS r, role_confidence AS rc, doc_id % 4 AS m, doc_id % 3 = 0 AS expl FROM docs),
q AS (SELECT *, CASE m WHEN 2 THEN 'unknown' WHEN 1 THEN 'partner_document' ELSE a END AS a2, CAST(CASE m WHEN 3 THEN 0.1 ELSE 0.92 END AS DOUBLE) AS ac2,
    CASE m WHEN 1 THEN 'letter_of_support' WHEN 3 THEN 'rfp' ELSE r END AS r2, CAST(CASE m WHEN 3 THEN 0.1 ELSE 0.95 END AS DOUBLE) AS rc2 FROM p),
t AS (SELECT *, a <> a2 AND a2 <> 'unknown' AND CASE WHEN a = 'unknown' THEN ac2 >= 0.4 WHEN ac >= 0.4 THEN expl AND ac2 > ac ELSE ac2 > ac END AS ta,
    r <> r2 AND r2 <> 'unknown' AND CASE WHEN r = 'unknown' THEN rc2 >= 0.4 WHEN rc >= 0.4 THEN expl AND rc2 > rc ELSE rc2 > rc END AS tr FROM q)
"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    first = documents(spark, sf).select("doc_id", *(c for pair in PAIRS for c in pair))
    return P.merge_passes(first, second_look(first), "doc_id", PAIRS, threshold=0.4)


@query(
    "merge_passes",
    f"""{MERGED} SELECT doc_id, CASE WHEN ta THEN a2 ELSE a END AS document_category, CASE WHEN ta THEN ac2 WHEN a = a2 THEN greatest(ac, ac2) ELSE ac END AS category_confidence,
        CASE WHEN tr THEN r2 ELSE r END AS document_role, CASE WHEN tr THEN rc2 WHEN r = r2 THEN greatest(rc, rc2) ELSE rc END AS role_confidence FROM t""",
)
def merge_passes(spark, sf):
    return merged(spark, sf).drop("changes")


@query(
    "change_log",
    f"""{MERGED} SELECT doc_id, 'document_category' AS field_path, a AS old_value, a2 AS new_value, printf('%.2f', ac) AS old_confidence,
            printf('%.2f', ac2) AS new_confidence, 'second look' AS reason FROM t WHERE ta
        UNION ALL SELECT doc_id, 'document_role', r, r2, printf('%.2f', rc), printf('%.2f', rc2), 'second look' FROM t WHERE tr""",
)
def change_log(spark, sf):
    return P.change_log(merged(spark, sf), "doc_id")


@query(
    "branch_signals",
    f"""{LABELLED}, o AS (SELECT x.doc_id, y.document_role AS v, count(*) AS n, min(y.ord) AS o FROM docs x JOIN docs y ON x.proposal_id = y.proposal_id
            AND x.doc_id <> y.doc_id AND y.document_role <> 'unknown' GROUP BY ALL),
        b AS (SELECT doc_id, arg_min(v, struct_pack(a := -n, b := o)) AS suggested FROM o GROUP BY 1)
        SELECT docs.doc_id, suggested FROM docs LEFT JOIN b USING (doc_id)""",
)
def branch_signals(spark, sf):
    return P.branch_signals(documents(spark, sf), "document_role", "ord").select("doc_id", "suggested")


@query(
    "context_neighbours",
    f"""{LABELLED}, s AS (SELECT *, greatest(category_confidence, role_confidence) AS score FROM docs),
        p AS (SELECT x.proposal_id, x.doc_id AS target, y.doc_id AS neighbour, y.score, bool_or(y.score >= 0.45) OVER (PARTITION BY x.doc_id) AS sure,
            row_number() OVER (PARTITION BY x.doc_id ORDER BY y.score DESC, y.document_id, y.scan_ord) AS n
            FROM s x JOIN s y ON x.proposal_id = y.proposal_id AND x.doc_id <> y.doc_id)
        SELECT proposal_id, NULL AS target, doc_id AS neighbour, score FROM s WHERE score >= 0.45
        UNION ALL SELECT proposal_id, target, neighbour, score FROM p WHERE NOT sure AND n <= 5""",
)
def context_neighbours(spark, sf):
    return P.context_neighbours(documents(spark, sf), threshold=0.45)


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf)


@query(
    "folder_counts",
    f"""{LABELLED}, c AS (SELECT proposal_id, count(*) AS n_open FROM docs WHERE document_role = 'unknown' GROUP BY 1)
        SELECT docs.proposal_id, count(*) FILTER (keep) AS n_included, count(*) FILTER (personal) AS n_review,
            count(*) FILTER (NOT keep AND NOT personal) AS n_excluded, coalesce(any_value(n_open), 0) AS n_open,
            count(*) FILTER (keep) > 0 AND coalesce(any_value(n_open), 0) = 0 AS ready
        FROM docs LEFT JOIN c USING (proposal_id) GROUP BY 1""",
)
def folder_counts(spark, sf):
    docs = reviewed(spark, sf)
    unclear = docs.where("document_role = 'unknown'").groupBy("proposal_id").agg(F.count("*").alias("n_open"))
    return S.folder_counts(docs, unclear)


@query(
    "rag_priority_summary",
    f"""{LABELLED} SELECT proposal_id, count(*) FILTER (rag_priority = 'high') AS n_high, count(*) FILTER (rag_priority = 'medium') AS n_medium,
        count(*) FILTER (rag_priority = 'low') AS n_low, count(*) FILTER (rag_priority = 'exclude') AS n_exclude,
        count(*) FILTER (personal) AS n_restricted FROM docs GROUP BY 1""",
)
def priority_summary(spark, sf):
    return S.priority_summary(reviewed(spark, sf))


@query(
    "detect_conflict",
    f"""{LABELLED} SELECT proposal_id, string_agg(DISTINCT version_status, ', ' ORDER BY version_status) AS conflicting, count(*) AS n_documents
        FROM docs WHERE version_status NOT IN ('', 'unknown') GROUP BY 1 HAVING count(DISTINCT version_status) > 1""",
)
def detect_conflict(spark, sf):
    return S.detect_conflict(documents(spark, sf), "version_status")


@query(
    "select_full_text",
    f"""{LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY CASE WHEN document_role IN {_in(rules.HIGH_VALUE_ROLES)} THEN 0 ELSE 1 END,
            CASE WHEN version_status IN ('final', 'submitted_version') THEN 0 ELSE 1 END, document_id, scan_ord) AS place
            FROM docs WHERE document_role NOT IN {_in(rules.LOW_VALUE_ROLES)} AND NOT budget AND NOT personal AND summary_detailed <> '')
        SELECT doc_id, CAST(place AS INTEGER) AS place, left(summary_detailed, 6000) AS excerpt FROM r WHERE place <= 8""",
)
def select_full_text(spark, sf):
    picked = S.select_full_text(documents(spark, sf), rules.LOW_VALUE_ROLES)
    return picked.select("doc_id", "place", "excerpt")


CLEAN = """CASE WHEN NOT keep THEN coalesce(exclude_reason, 'include_in_clean_set_false') WHEN personal THEN 'manual_review_required: ' || review_reasons END"""


@query(
    "exclusions",
    f"""{LABELLED}, {CLASSED}, bare AS (SELECT doc_id, document_id, proposal_id, relative_path, 'no_document_metadata: ' ||
            CASE WHEN eligible THEN 'pending_analysis' WHEN extension IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.gif', '.bmp', '.webp') THEN 'ignored_image'
                WHEN extension = '.zip' THEN 'zip_inventory_only' WHEN extension IN ('.ppt', '.pptx') THEN 'powerpoint_inventory_only'
                ELSE 'unsupported_file_type' END AS exclusion_reason
            FROM classed WHERE document_id NOT IN (SELECT document_id FROM docs))
        SELECT doc_id, document_id, proposal_id, relative_path, {CLEAN} AS exclusion_reason FROM docs WHERE {CLEAN} IS NOT NULL
        UNION ALL SELECT * FROM bare""",
)
def exclusions(spark, sf):
    return S.exclusions(reviewed(spark, sf), I.classify_files(X.inventory(spark, sf)))


PLANNED = rf"""{LABELLED},
a AS (SELECT *, {SAFE} AS safe FROM docs WHERE {CLEAN} IS NULL),
{NAMES},
plan AS (SELECT doc_id, proposal_id, document_id, year_folder, proposal_branch, year_folder || '/' || proposal_branch || '/documents/' || target_name AS clean_path FROM names)
"""


@query("plan_clean_set", f"{PLANNED} SELECT doc_id, clean_path FROM plan")
def plan_clean_set(spark, sf):
    return S.plan_clean_set(reviewed(spark, sf)).select("doc_id", "clean_path")


@query(
    "manifest",
    f"""{PLANNED} SELECT 'document' AS object_type, proposal_id, document_id, 'archive/' || clean_path AS key FROM plan
        UNION ALL SELECT DISTINCT 'proposal', proposal_id, NULL, 'archive/' || year_folder || '/' || proposal_branch || '/metadata/proposal.json' FROM plan""",
)
def manifest(spark, sf):
    return S.manifest(S.plan_clean_set(reviewed(spark, sf)))


@query(
    "provenance",
    f"""{LABELLED} SELECT proposal_id, doc_id, document_id, CASE WHEN budget OR personal THEN 'excluded' WHEN authority_rank = 'authoritative' THEN 'authoritative'
            WHEN NOT useful AND NOT boilerplate AND rag_priority = 'exclude' THEN 'excluded'
            WHEN contains_unique_reasoning THEN 'retained' ELSE 'downgraded' END AS fate FROM lin""",
)
def provenance(spark, sf):
    return S.provenance(C.treatments(C.lineage(documents(spark, sf)))).drop("policy_applied")
