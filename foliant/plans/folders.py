"""Queries of groups' facts, options of the clean set and the whole manifest, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import rules
from foliant.operators import answers as N
from foliant.operators import classify as C
from foliant.operators import clean_set as S
from foliant.operators import folders as L
from foliant.operators import identity as Y
from foliant.operators import inventory as I
from foliant.plans.registry import DOCS, INV, KEY_ROLES, LABELLED, NAMES, SAFE, _ORDER, documents, query
from foliant.plans.records import IDENTIFYING, IDENTITY, matched, placed
from foliant.plans.runs import TREATED, treated
from foliant.sources import fixtures as X
from foliant.sources import tables as T


@query(
    "folder_key_documents",
    f"""{LABELLED}, r AS (SELECT *, {_ORDER} AS o, row_number() OVER (PARTITION BY proposal_id, {_ORDER} ORDER BY NOT keep, ord) AS n FROM docs),
        b AS (SELECT *, CASE WHEN o < {len(KEY_ROLES)} AND n = 1 THEN 0 WHEN rag_priority = 'high' THEN 1 END AS band FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY band, CASE WHEN band = 0 THEN o END NULLS FIRST, ord) AS key_rank FROM b WHERE band IS NOT NULL)
        SELECT proposal_id, document_id, document_role, keep AS included, CAST(key_rank AS INTEGER) AS key_rank FROM k WHERE key_rank <= 6""",
)
def folder_key_documents(spark, sf):
    return L.folder_key_documents(documents(spark, sf), KEY_ROLES, "ord", 6)


@query(
    "folder_readiness",
    f"""{LABELLED}, c AS (SELECT proposal_id, count(*) AS n FROM docs WHERE h % 32 = 5 GROUP BY 1)
        SELECT docs.proposal_id, count(*) FILTER (keep) > 0 AND coalesce(any_value(n), 0) = 0 AS ready_for_clean_set,
            count(*) FILTER (keep) > 0 AND coalesce(any_value(n), 0) = 0 AND NOT bool_or(personal AND h % 2 = 0) AS ready_for_future_s3
        FROM docs LEFT JOIN c USING (proposal_id) GROUP BY 1""",
)
def folder_readiness(spark, sf):
    docs = documents(spark, sf)
    open_ones = docs.where("h % 32 = 5").groupBy("proposal_id").agg(F.count("*").alias("n_open"))
    return L.readiness(docs, open_ones, F.col("contains_personal_info") & (F.col("h") % 2 == 0))


#: What a page tells of documents, beside what identifies their group.
SHOWN = ("document_id", "document_role", "file_name_original", "rag_priority", "include_in_clean_set", "manual_review_required", "contains_personal_info", "h")


@query(
    "folder_page",
    f"""{IDENTITY}, c AS (SELECT proposal_id, count(*) AS n FROM docs WHERE h % 32 = 5 GROUP BY 1),
        rd AS (SELECT docs.proposal_id, count(*) FILTER (keep) > 0 AND coalesce(any_value(n), 0) = 0 AS r1,
            count(*) FILTER (keep) > 0 AND coalesce(any_value(n), 0) = 0 AND NOT bool_or(personal AND h % 2 = 0) AS r2,
            count(*) FILTER (keep) AS k, count(*) FILTER (NOT keep AND NOT personal) AS o, count(*) FILTER (personal) AS v, count(*) AS a FROM docs LEFT JOIN c USING (proposal_id) GROUP BY 1),
        r AS (SELECT *, {_ORDER} AS o, row_number() OVER (PARTITION BY proposal_id, {_ORDER} ORDER BY NOT keep, ord) AS n FROM docs),
        b AS (SELECT *, CASE WHEN o < {len(KEY_ROLES)} AND n = 1 THEN 0 WHEN rag_priority = 'high' THEN 1 END AS band FROM r),
        ks AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY band, CASE WHEN band = 0 THEN o END NULLS FIRST, ord) AS key_rank FROM b WHERE band IS NOT NULL),
        kl AS (SELECT proposal_id, string_agg('- ' || document_role || ': ' || file_name_original || CASE WHEN keep THEN '' ELSE ' (left out)' END, chr(10) ORDER BY key_rank) AS l
            FROM ks WHERE key_rank <= 6 GROUP BY 1)
        SELECT proposal_id, concat_ws(chr(10) || chr(10), '# ' || proposal_name, agency || ' / ' || program || ' / ' || status || ' / ' || award_status, 'Led by ' || lead_organization,
            'Sent on ' || submission_date, '| kept | left out | under review | all |' || chr(10) || '|-|-|-|-|' || chr(10) || '| ' || k || ' | ' || rd.o || ' | ' || v || ' | ' || a || ' |',
            '## Key documents' || chr(10) || l, '## Tracker' || chr(10) || match_status || CASE WHEN disagreements <> '' THEN '; differs in ' || replace(disagreements, ';', ', ') ELSE '' END,
            '## Ready' || chr(10) || 'clean set: ' || CASE WHEN r1 THEN 'yes' ELSE 'no' END || '; storage: ' || CASE WHEN r2 THEN 'yes' ELSE 'no' END) AS page
        FROM ident JOIN rd USING (proposal_id) LEFT JOIN kl USING (proposal_id)""",
)
def folder_page(spark, sf):
    # A page doesn't name partners, so they are not gathered.
    docs = placed(documents(spark, sf).select(*(c for c in IDENTIFYING if c != "partners"), *SHOWN))
    keys = L.folder_key_documents(docs, KEY_ROLES, "place", 6, ["file_name_original"])
    open_ones = docs.where("h % 32 = 5").groupBy("proposal_id").agg(F.count("*").alias("n_open"))
    ready = L.readiness(docs, open_ones, F.col("contains_personal_info") & (F.col("h") % 2 == 0))
    known = T.stored(Y.canonical_identity(docs, matched(spark, sf), "place"))
    return L.folder_page(known, docs, keys, ready)


@query(
    "joined_starts",
    f"""{LABELLED} SELECT proposal_id, coalesce(left(string_agg(trim(summary_short), ' ' ORDER BY ord) FILTER (document_category = 'opportunity_document' AND trim(summary_short) <> ''), 500), '') AS opportunity_context,
        coalesce(left(string_agg(trim(summary_short), ' ' ORDER BY ord) FILTER (keep AND origin_type = 'generated_response' AND trim(summary_short) <> ''), 500), '') AS generated_response FROM docs GROUP BY 1""",
)
def joined_starts(spark, sf):
    docs = T.stored(documents(spark, sf).select("proposal_id", "ord", "summary_short", "document_category", "origin_type", "include_in_clean_set"))
    of = {
        "opportunity_context": F.col("document_category") == "opportunity_document",
        "generated_response": F.col("include_in_clean_set") & (F.col("origin_type") == "generated_response"),
    }
    return L.joined_starts(docs, of, "summary_short", "ord")


FIRST = ("phase", "topic_number", "solicitation_number", "submission_date", "lead_organization")


@query(
    "first_known",
    f"""{LABELLED}, f AS (SELECT *, ['Phase I', 'Phase II', 'unknown', ''][h % 4 + 1] AS phase, CASE WHEN h2 % 3 <> 1 THEN 'T' || h2 % 9 END AS topic_number,
            CASE WHEN h % 5 = 0 THEN 'unknown' WHEN h % 5 < 3 THEN 'FOA-' || h2 % 7 END AS solicitation_number FROM docs)
        SELECT proposal_id, {", ".join(f"arg_min({c}, ord) FILTER ({c} NOT IN ('', 'unknown')) AS {c}" for c in FIRST)} FROM f GROUP BY 1""",
)
def first_known(spark, sf):
    h, h2 = F.col("h"), F.col("h2")
    made = documents(spark, sf).withColumns(
        {
            "phase": X.pick(("Phase I", "Phase II", "unknown", ""), h % 4), "topic_number": F.when(h2 % 3 != 1, F.concat(F.lit("T"), (h2 % 9).cast("string"))),
            "solicitation_number": F.when(h % 5 == 0, "unknown").when(h % 5 < 3, F.concat(F.lit("FOA-"), (h2 % 7).cast("string"))),
        }
    )
    return L.first_known(made, FIRST, "ord")


@query(
    "narrative",
    f"""{LABELLED}, f AS (SELECT *, trim(summary_short) AS s FROM lin),
        g AS (SELECT proposal_id, bool_or(authority_rank = 'authoritative') AS a, arg_min(s, ord) FILTER (authority_rank = 'authoritative' AND s <> '') AS sa,
            arg_min(s, ord) FILTER (keep AND s <> '') AS sc, arg_min(s, ord) FILTER (document_role = 'commercialization_plan' AND s <> '') AS p,
            count(*) FILTER (document_role = 'review_feedback' AND s <> '') AS n FROM f GROUP BY 1),
        fb AS (SELECT proposal_id, string_agg(s, '|' ORDER BY ord) AS fb FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY ord) AS k FROM f
            WHERE document_role = 'review_feedback' AND s <> '') WHERE k <= 5 GROUP BY 1),
        wd AS (SELECT proposal_id, ord, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS item FROM (SELECT *, string_split_regex(s, '[ \\t\\r\\n]+') AS w FROM f)),
        wf AS (SELECT proposal_id, item, min(struct_pack(o := ord, p := p)) AS pos, length(item) > 9 AS big FROM wd WHERE trim(item) <> '' AND (length(item) > 9 OR contains(item, 'q')) GROUP BY ALL),
        wk AS (SELECT *, row_number() OVER (PARTITION BY proposal_id, big ORDER BY pos) AS k FROM wf),
        ap AS (SELECT proposal_id, string_agg(item, '|' ORDER BY pos) AS apps FROM wk WHERE big AND k <= 5 GROUP BY 1),
        tg AS (SELECT proposal_id, item, pos, row_number() OVER (PARTITION BY proposal_id ORDER BY pos) AS k FROM wf WHERE contains(item, 'q')),
        t2 AS (SELECT proposal_id, string_agg(item, '|' ORDER BY pos) AS targets FROM tg WHERE k <= 5 GROUP BY 1),
        st AS (SELECT proposal_id, min(status) || ' (' || min(award_status) || ')' AS outcome FROM docs GROUP BY 1)
        SELECT proposal_id, n AS n_feedback, coalesce(CASE WHEN a THEN sa ELSE sc END, '') AS technical_objective, coalesce(CASE WHEN a THEN sa ELSE sc END, '') AS proposed_approach,
            coalesce(p, '') AS commercial_strategy, coalesce(fb, '') AS reviewer_feedback, coalesce(apps, '') AS target_applications, coalesce(targets, '') AS key_performance_targets, outcome
        FROM g LEFT JOIN fb USING (proposal_id) LEFT JOIN ap USING (proposal_id) LEFT JOIN t2 USING (proposal_id) JOIN st USING (proposal_id)""",
)
def narrative(spark, sf):
    words = F.split(F.trim("summary_short"), r"[ \t\r\n]+")
    made = T.stored(C.lineage(documents(spark, sf)).select(
        "doc_id", "proposal_id", "ord", "authority_rank", "include_in_clean_set", "document_role", "summary_short", "summary_detailed", "status", "award_status",
        F.filter(words, lambda w: F.length(w) > 9).alias("apps"), F.filter(words, lambda w: w.contains("q")).alias("targets"),
    ))
    identity = made.groupBy("proposal_id").agg(F.min("status").alias("status"), F.min("award_status").alias("award_status"))
    out = L.narrative(made, identity, "ord", "apps", "targets", most=5)
    return out.withColumns({c: F.array_join(c, "|") for c in ("target_applications", "key_performance_targets", "reviewer_feedback")})


@query(
    "compare_outcomes",
    f"""{LABELLED}, o AS (SELECT proposal_branch, min(status) AS status, min(agency) AS agency, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (h % 3 = 0) AS INTEGER) AS q FROM docs GROUP BY 1),
        rl AS (SELECT proposal_branch, coalesce(string_agg(DISTINCT document_role, ' ' ORDER BY document_role) FILTER (authority_rank = 'authoritative'), '') AS a,
            coalesce(string_agg(DISTINCT document_role, ' ' ORDER BY document_role) FILTER (NOT keep), '') AS x FROM docs GROUP BY 1),
        e AS (SELECT * FROM o JOIN rl USING (proposal_branch))
        SELECT proposal_branch, 'status' AS "check", 'awarded' AS expected, status AS found FROM e WHERE status <> 'awarded'
        UNION ALL SELECT proposal_branch, 'agency', 'NSF', agency FROM e WHERE contains(proposal_branch, 'NSF') AND agency <> 'NSF'
        UNION ALL SELECT proposal_branch, 'document_count', '12', CAST(n AS VARCHAR) FROM e WHERE n <> 12
        UNION ALL SELECT proposal_branch, 'max_question_count', '2', CAST(q AS VARCHAR) FROM e WHERE q > 2
        UNION ALL SELECT proposal_branch, 'authoritative_document_roles', 'budget technical_volume', a FROM e WHERE a <> 'budget technical_volume'
        UNION ALL SELECT proposal_branch, 'excluded_from_rag_document_roles', '', x FROM e WHERE x <> ''
        UNION ALL SELECT 'Nowhere', 'present', 'true', 'false'""",
)
def compare_outcomes(spark, sf):
    docs = documents(spark, sf)
    by_branch = docs.groupBy("proposal_branch").agg(
        F.min("status").alias("status"), F.min("agency").alias("agency"), F.count("*").cast("int").alias("document_count"), F.count_if(F.col("h") % 3 == 0).cast("int").alias("question_count")
    )
    ranked = docs.withColumn("authority_rank", C.authority_rank())
    role = lambda rows, kind: rows.select("proposal_branch", "document_role", F.lit(kind).alias("kind"))
    roles = role(ranked.where("authority_rank = 'authoritative'"), "authoritative").unionByName(role(ranked.where("not include_in_clean_set"), "excluded"))
    branches = by_branch.select("proposal_branch").unionByName(spark.range(1).select(F.lit("Nowhere").alias("proposal_branch")))
    expected = branches.select(
        "proposal_branch", F.lit("awarded").alias("status"), F.when(F.col("proposal_branch").contains("NSF"), "NSF").alias("agency"), F.lit(12).alias("document_count"),
        F.lit(2).alias("max_question_count"), F.array(F.lit("technical_volume"), F.lit("budget")).alias("authoritative_document_roles"),
        F.array().cast("array<string>").alias("excluded_from_rag_document_roles"),
    )
    return L.compare_outcomes(by_branch, roles, expected)


#: The plan with folders kept and reviews not waited for: names differ inside a folder only.
IN_FOLDERS = NAMES.replace("proposal_id, ", "proposal_id, inside, ").replace("free.proposal_id = l.proposal_id", "free.proposal_id = l.proposal_id AND free.inside = l.inside")
OPTIONS = rf"""{LABELLED},
a AS (SELECT *, {SAFE} AS safe, array_to_string(list_transform(string_split(relative_path, '/')[:-2], lambda x: coalesce(nullif(trim(regexp_replace(regexp_replace(x, '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'),
    '\s+', '_', 'g'), '._'), ''), 'file')), '/') AS inside FROM docs WHERE keep),
{IN_FOLDERS},
plan AS (SELECT *, year_folder || '/' || proposal_branch || '/documents/' || inside || '/' || target_name AS clean_path FROM names)
"""


@query("clean_set_options", f"{OPTIONS} SELECT doc_id, clean_path FROM plan")
def clean_set_options(spark, sf):
    return S.plan_clean_set(documents(spark, sf), flatten=False, require_clearance=False).select("doc_id", "clean_path")


@query(
    "manifest_rows",
    f"""{OPTIONS}, {TREATED.removeprefix(LABELLED + ",")}
        SELECT 'document' AS object_type, proposal_id, trx.document_id, trx.file_name_original, clean_path AS local_clean_path, 'archive/' || clean_path AS recommended_key,
            keep AS include_in_future_rag, trx.rag_priority, trx.document_role, trx.version_status, trx.authority_rank, recommended_treatment AS recommended_rag_treatment,
            trx.authority_rank = 'authoritative' AS is_authoritative, superseded_by_document_id, contains_unique_reasoning,
            concat_ws(',', CASE WHEN budget THEN 'budget_or_rates' END, CASE WHEN personal THEN 'personal_info' END) AS sensitivity_labels, proposal_id AS parent_proposal_record
        FROM trx JOIN (SELECT doc_id, clean_path FROM plan) USING (doc_id)
        UNION ALL SELECT DISTINCT 'proposal_record', proposal_id, NULL, NULL, year_folder || '/' || proposal_branch || '/metadata/retrieval.json',
            'archive/' || year_folder || '/' || proposal_branch || '/metadata/proposal.json', true, 'high', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', NULL FROM docs""",
)
def manifest_rows(spark, sf):
    docs = documents(spark, sf)
    groups = docs.select("proposal_id", "year_folder", "proposal_branch").distinct()
    out = S.manifest_rows(S.plan_clean_set(docs, flatten=False, require_clearance=False), treated(spark, sf), groups)
    return out.withColumn("sensitivity_labels", F.coalesce(F.array_join("sensitivity_labels", ","), F.lit("")))


_EVIDENCE = " ".join(f"WHEN contains(lower(stem), '{w}') THEN 'The file name has \'\'{w}\'\'.'" for words, _ in rules.VERSION_RULES for w in words).replace("\\'", "'")
RECORD = (*C.UNSURE_OF, *C.FAIRLY_SURE_OF)


@query(
    "classify_records",
    f"""{INV}, {DOCS}, e AS (SELECT *, extension IN ('.pdf', '.docx', '.doc', '.csv', '.txt', '.md', '.xlsx', '.xls') AS eligible FROM d4)
        SELECT doc_id, category_confidence AS document_category_confidence, role_confidence AS document_role_confidence,
            {", ".join(f"CAST({0.3 if c in C.UNSURE_OF else 0.45} AS DOUBLE) AS {c}_confidence" for c in RECORD)},
            CASE {_EVIDENCE} ELSE 'The file name has no word for a version.' END AS draft_or_final_evidence, eligible AS include_in_clean_set,
            eligible AND rag_priority <> 'exclude' AS include_in_future_rag, CASE WHEN eligible THEN 'Files of this kind are processed.' END AS include_reason,
            CASE WHEN NOT eligible THEN 'Files of this kind are not processed.' END AS exclude_reason,
            concat_ws('|', CASE WHEN budget THEN 'financial_sensitive' END, CASE WHEN personal THEN 'personal_info' END) AS labels, useful AS useful_context, boilerplate FROM e""",
)
def classify_records(spark, sf):
    made = C.with_records(C.classify_documents(I.classify_files(X.inventory(spark, sf))))
    return made.select(
        "doc_id", "document_category_confidence", "document_role_confidence", *(f"{c}_confidence" for c in RECORD), "draft_or_final_evidence",
        "include_in_clean_set", "include_in_future_rag", "include_reason", "exclude_reason", F.array_join("sensitivity_labels", "|").alias("labels"),
        F.col("useful_context_summary").isNotNull().alias("useful_context"), F.col("boilerplate_summary").isNotNull().alias("boilerplate"),
    )


#: Fields that the answers below are about, with what they say of each.
SAID = {
    "include_in_clean_set": ("no", "yes", "perhaps"), "document_role": ("budget", "poem"), "origin_type": ("award", "mars"), "sensitivity_labels": ("internal|public", "secret", '["personal_info"]'),
    "phase": ("Phase II",), "needs_powerpoint_processing": ("yes", "maybe"), "include_in_future_rag": ("yes", "no"), "recommended_rag_treatment": ("manual_review", "bin"),
}
_PICKED = " ".join(f"WHEN '{f}' THEN {X._list(v)}[h2 % {len(v)} + 1]" for f, v in SAID.items())
#: Answers about inclusion are judged in order of seq, each by what the ones before it left of its document; a content's copies are
#: one document, the least of their records.
REVIEWED = f"""{LABELLED},
x0 AS (SELECT *, {X._list(tuple(SAID))}[h % 8 + 1] AS field, CASE WHEN h2 % 5 = 4 THEN 'doc_none' ELSE document_id END AS about FROM docs WHERE h % 3 <> 1),
x1 AS (SELECT doc_id AS seq, about, document_id, field, CASE field {_PICKED} END AS a, h2 % 7 = 6 AS skip, keep, coalesce(include_reason, '') <> '' AS why, coalesce(exclude_reason, '') <> '' AS why_not FROM x0),
x2 AS (SELECT *, CASE WHEN field IN ('include_in_clean_set', 'include_in_future_rag', 'needs_powerpoint_processing') THEN CASE a WHEN 'yes' THEN 'true' WHEN 'no' THEN 'false' END
    WHEN field = 'document_role' AND a = 'poem' OR field = 'origin_type' AND a = 'mars' OR field = 'recommended_rag_treatment' AND a = 'bin' THEN NULL
    WHEN a = '["personal_info"]' THEN 'personal_info' ELSE a END AS value FROM x1),
x3 AS (SELECT *, CASE WHEN skip THEN NULL WHEN field = 'needs_powerpoint_processing' AND about = 'doc_none' THEN CASE WHEN value IS NULL THEN 'neither yes nor no: ' || a END
    WHEN about = 'doc_none' THEN 'no such document' WHEN field = 'needs_powerpoint_processing' THEN 'no answers are taken for this field: ' || field
    WHEN value IS NULL THEN CASE WHEN field = 'include_in_clean_set' THEN 'neither yes nor no: ' || a ELSE 'no value of ' || field || ': ' || a END
    WHEN field = 'sensitivity_labels' AND a = 'secret' THEN 'no known label'
    END AS wrong FROM x2),
xs AS (SELECT about AS document_id, list(struct_pack(q := seq, of_clean := field = 'include_in_clean_set', yes := value = 'true', clean := NULL::BOOLEAN, rag := NULL::BOOLEAN,
    why := NULL::BOOLEAN, why_not := NULL::BOOLEAN, bad := NULL::BIGINT[]) ORDER BY seq) AS steps FROM x3
    WHERE NOT skip AND wrong IS NULL AND field IN ('include_in_clean_set', 'include_in_future_rag') GROUP BY 1),
xo AS (SELECT document_id, min(struct_pack(k := keep, w := coalesce(include_reason, '') <> '', n := coalesce(exclude_reason, '') <> '')) AS o FROM docs GROUP BY 1),
xf AS (SELECT list_prepend(struct_pack(q := NULL::BIGINT, of_clean := NULL::BOOLEAN, yes := NULL::BOOLEAN, clean := o.k, rag := o.k, why := o.w, why_not := o.n, bad := []::BIGINT[]), steps) AS l
    FROM xs JOIN xo USING (document_id)),
xb AS (SELECT unnest(list_reduce(l, lambda s, x: CASE
    WHEN CASE WHEN CASE WHEN x.of_clean THEN x.yes OR s.rag ELSE s.clean OR x.yes END THEN s.why ELSE s.why_not END
    THEN struct_pack(q := x.q, of_clean := x.of_clean, yes := x.yes, clean := CASE WHEN x.of_clean THEN x.yes ELSE s.clean END, rag := CASE WHEN x.of_clean THEN s.rag ELSE x.yes END,
        why := s.why, why_not := s.why_not, bad := s.bad)
    ELSE struct_pack(q := x.q, of_clean := x.of_clean, yes := x.yes, clean := s.clean, rag := s.rag, why := s.why, why_not := s.why_not, bad := list_append(s.bad, x.q)) END).bad) AS seq FROM xf),
xe AS (SELECT *, CASE WHEN seq IN (SELECT seq FROM xb) THEN '{N.NO_REASON}' ELSE wrong END AS error FROM x3),
x4 AS (SELECT *, CASE WHEN skip THEN 'skipped' WHEN error IS NULL THEN 'applied' ELSE 'invalid' END AS state FROM xe)
"""


def reviewed(spark, sf):
    h, h2 = F.col("h"), F.col("h2")
    docs = documents(spark, sf).withColumns({"phase": F.lit("Phase I"), "sensitivity_labels": F.array(F.lit("unknown")), "recommended_rag_treatment": F.lit("exclude")})
    said = F.lit(None).cast("string")
    for field, given in SAID.items():
        said = F.when(F.col("field") == field, X.pick(given, h2 % len(given))).otherwise(said)
    answers = docs.where("h % 3 <> 1").withColumn("field", X.pick(tuple(SAID), h % 8)).select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question_id"), F.when(h2 % 5 == 4, "doc_none").otherwise(F.col("document_id")).alias("document_id"), "field",
        said.alias("user_answer"), F.when(h2 % 7 == 6, "skipped").otherwise("open").alias("status"), F.col("doc_id").alias("seq"),
    )
    return N.apply_reviewed_answers(docs, answers)


@query("reviewed_answers", f"{REVIEWED} SELECT seq, field, state, error FROM x4")
def reviewed_answers(spark, sf):
    return reviewed(spark, sf)[1].select("seq", "field", "state", "error")


@query("deck_answers", f"{REVIEWED} SELECT seq, 'q' || seq AS question_id, value = 'true' AS needs_processing FROM x4 WHERE state = 'applied' AND field = 'needs_powerpoint_processing'")
def deck_answers(spark, sf):
    return reviewed(spark, sf)[2].select("seq", "question_id", "needs_processing")


@query(
    "reviewed_documents",
    f"""{REVIEWED}, n AS (SELECT document_id, {", ".join(f"arg_max(value, seq) FILTER (field = '{f}') AS n_{f}" for f in SAID)} FROM x4 WHERE state = 'applied' AND about <> 'doc_none' GROUP BY 1)
        SELECT doc_id, coalesce(n_include_in_clean_set = 'true', keep) AS include_in_clean_set, coalesce(n_include_in_future_rag = 'true', keep) AS include_in_future_rag,
            coalesce(n_document_role, document_role) AS document_role, coalesce(n_origin_type, origin_type) AS origin_type, coalesce(n_phase, 'Phase I') AS phase,
            coalesce(n_sensitivity_labels, 'unknown') AS labels, coalesce(n_recommended_rag_treatment, 'exclude') AS recommended_rag_treatment FROM docs LEFT JOIN n USING (document_id)""",
)
def reviewed_documents(spark, sf):
    return reviewed(spark, sf)[0].select(
        "doc_id", "include_in_clean_set", "include_in_future_rag", "document_role", "origin_type", "phase", F.array_join("sensitivity_labels", "|").alias("labels"), "recommended_rag_treatment"
    )
