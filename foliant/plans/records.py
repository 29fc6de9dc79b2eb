"""Queries of identity, tracker overrides, answers, records and runs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant import rules
from foliant.functions import text as T
from foliant.operators import answers as N
from foliant.operators import classify as C
from foliant.operators import clean_set as S
from foliant.operators import decisions as D
from foliant.operators import identity as Y
from foliant.operators import inventory as I
from foliant.operators import records as K
from foliant.operators import responses as R
from foliant.operators import second_pass as P
from foliant.operators import tracker as M
from foliant.plans import registry as G
from foliant.plans.registry import DECIDED, DECKS, INV, LABELLED, OVERRIDES, documents, query
from foliant.plans.review import PLANNED
from foliant.sources import fixtures as X
from foliant.sources import tables as W


def matched(spark: SparkSession, sf: str) -> DataFrame:
    groups = X.inventory(spark, sf).where("proposal_branch is not null").select("proposal_id", "proposal_branch").distinct()
    rows = W.stored(X.tracker(spark, sf))
    return Y.matched_rows(M.match_tracker(groups, rows), rows)


TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: length(t) > 1))"
MATCHED = f"""{X.TRACKER_SQL},
mh AS (SELECT DISTINCT proposal_id, {TOKENS.format("proposal_branch")} AS ht FROM inventory WHERE proposal_branch IS NOT NULL),
mr AS (SELECT row_id, {TOKENS.format("proposal_name")} AS rt FROM tracker),
ms AS (SELECT proposal_id, row_id, len(list_intersect(ht, rt)) / (len(ht) + len(rt) - len(list_intersect(ht, rt))) AS score FROM mh, mr),
mb AS (SELECT proposal_id, max(score) AS best FROM ms GROUP BY 1),
mk AS (SELECT ms.proposal_id, any_value(best) AS best, count(*) AS n, min(row_id) AS top FROM ms JOIN mb ON mb.proposal_id = ms.proposal_id AND best - score < 0.05
    WHERE best >= 0.35 GROUP BY 1),
mt AS (SELECT mh.proposal_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status,
    coalesce(best, 0.0) AS match_confidence, CASE WHEN n = 1 THEN top END AS row_id FROM mh LEFT JOIN mk USING (proposal_id)),
mtr AS (SELECT mt.*, proposal_name AS t_name, submission_date AS t_sent, selection_notification_date AS t_notice, award_date AS t_award_date, status AS t_status,
    coalesce(award_status, result) AS t_award FROM mt LEFT JOIN tracker USING (row_id))
"""


def _vote(field: str) -> str:
    return f"""v_{field} AS (SELECT proposal_id, {field} AS v, count(*) AS n FROM docs WHERE {field} NOT IN ('', 'unknown') GROUP BY ALL),
t_{field} AS (SELECT proposal_id, CASE WHEN count(*) = 1 THEN min(v) END AS {field} FROM v_{field} x
    WHERE n = (SELECT max(n) FROM v_{field} y WHERE y.proposal_id = x.proposal_id) GROUP BY 1)"""


_VOTED = ("canonical_proposal_name", "agency", "program", "status", "award_status")
IDENTITY = f"""{LABELLED}, {MATCHED}, {", ".join(map(_vote, _VOTED))},
i0 AS (SELECT proposal_id, min(proposal_branch) AS proposal_branch, count(*) AS document_count,
    arg_min(submission_date, ord) FILTER (submission_date IS NOT NULL) AS submission_date,
    arg_min(lead_organization, ord) FILTER (lead_organization IS NOT NULL) AS lead_organization FROM docs GROUP BY 1),
pe AS (SELECT proposal_id, ord, unnest(range(1, len(partners) + 1)) AS p, unnest(partners) AS item FROM docs),
pf AS (SELECT proposal_id, item, min(struct_pack(o := ord, p := p)) AS pos FROM pe WHERE trim(item) <> '' GROUP BY ALL),
pl AS (SELECT proposal_id, list(item ORDER BY pos) AS partners FROM pf GROUP BY 1),
i1 AS (SELECT i0.*, coalesce(canonical_proposal_name, proposal_branch) AS own_name, coalesce(agency, 'unknown') AS agency, coalesce(program, 'unknown') AS program,
    coalesce(t_status.status, 'unknown') AS own_status, coalesce(t_award_status.award_status, 'unknown') AS own_award, coalesce(partners, []) AS partners
    FROM i0 LEFT JOIN t_canonical_proposal_name USING (proposal_id) LEFT JOIN t_agency USING (proposal_id) LEFT JOIN t_program USING (proposal_id)
    LEFT JOIN t_status USING (proposal_id) LEFT JOIN t_award_status USING (proposal_id) LEFT JOIN pl USING (proposal_id)),
ident AS (SELECT i1.* REPLACE (coalesce(t_sent, submission_date) AS submission_date), coalesce(t_name, own_name) AS proposal_name, coalesce(t_status, own_status) AS status,
    coalesce(t_award, own_award) AS award_status, match_status, row_id, t_notice AS selection_notification_date, t_award_date AS award_date,
    concat_ws(';', CASE WHEN t_name <> own_name THEN 'canonical_proposal_name' END, CASE WHEN submission_date <> t_sent THEN 'submission_date' END,
        CASE WHEN t_status <> own_status THEN 'status' END, CASE WHEN t_award <> own_award THEN 'award_status' END) AS disagreements
    FROM i1 LEFT JOIN mtr USING (proposal_id))
"""
FIELDS_OF = lambda c: F.array_join(F.transform(c, lambda d: d["field"]), ";")


#: What a group's identity is made of.
IDENTIFYING = (
    "proposal_id", "proposal_branch", "canonical_proposal_name", "agency", "program", "status", "award_status", "submission_date", "lead_organization", "partners", "ord",
)


def listed(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Documents with what identifies their group, and more columns, written once for all that a query makes of them."""
    return W.stored(documents(spark, sf).select(*IDENTIFYING, *more))


def placed(docs: DataFrame) -> DataFrame:
    """Documents with their place in their group in order of ord, a number that stands for that long text in what follows,
    written once, each group's in one file, so that they are aggregated before they are shuffled again."""
    return W.stored(docs.withColumn("place", F.row_number().over(Window.partitionBy("proposal_id").orderBy("ord"))).drop("ord"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of groups' documents, which need no labels."""
    inv = X.inventory(spark, sf).where("proposal_branch is not null").withColumn("ord", F.concat_ws("|", "document_id", "scan_ord"))
    return inv.select("proposal_id", "ord", "file_name_original", "summary_short")


def identity(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    return Y.canonical_identity(docs or listed(spark, sf), matched(spark, sf), "ord")


@query(
    "canonical_identity",
    f"""{IDENTITY} SELECT proposal_id, proposal_name, agency, program, status, award_status, submission_date, selection_notification_date, award_date,
        lead_organization, array_to_string(partners, '|') AS partners, document_count, match_status, row_id, disagreements FROM ident""",
)
def canonical_identity(spark, sf):
    found = identity(spark, sf).withColumn("partners", F.array_join("partners", "|")).withColumn("disagreements", FIELDS_OF("disagreements"))
    return found.drop("proposal_branch")


@query(
    "tracker_override_documents",
    f"""{LABELLED}, {MATCHED}, c AS (SELECT docs.*, mtr.* EXCLUDE (proposal_id) FROM docs LEFT JOIN mtr USING (proposal_id))
        SELECT doc_id, coalesce(t_sent, submission_date) AS submission_date, coalesce(t_status, status) AS status, coalesce(t_award, award_status) AS award_status,
        t_notice AS response_date, coalesce(match_status, 'not_attempted') AS match_status, row_id, concat_ws(';',
        {", ".join(f"CASE WHEN coalesce({t}, '') <> '' AND regexp_replace(lower(coalesce({o}, '')), '[^a-z0-9]', '', 'g') <> regexp_replace(lower({t}), '[^a-z0-9]', '', 'g') THEN '{f}' END"
            for f, o, t in (("canonical_proposal_name", "canonical_proposal_name", "t_name"), ("submission_date", "submission_date", "t_sent"),
                            ("response_date", "NULL", "t_notice"), ("status", "status", "t_status"), ("award_status", "award_status", "t_award")))}) AS disagreements FROM c""",
)
def override_documents(spark, sf):
    out = Y.override_documents(documents(spark, sf), matched(spark, sf)).withColumn("disagreements", FIELDS_OF("disagreements"))
    return out.select("doc_id", "submission_date", "status", "award_status", "response_date", "match_status", "row_id", "disagreements")


@query(
    "proposal_summary",
    f"""{IDENTITY}, f AS (SELECT lin.*, trim(summary_short) AS s FROM lin),
        g AS (SELECT proposal_id, bool_or(authority_rank = 'authoritative') AS a, arg_min(s, ord) FILTER (authority_rank = 'authoritative' AND s <> '') AS sa,
            arg_min(s, ord) FILTER (keep AND s <> '') AS sc, arg_min(s, ord) FILTER (document_role = 'commercialization_plan' AND s <> '') AS p,
            string_agg(s, '|' ORDER BY ord) FILTER (document_role = 'review_feedback' AND s <> '') AS fb FROM f GROUP BY 1)
        SELECT proposal_id, coalesce(CASE WHEN a THEN sa ELSE sc END, '') AS technical_objective, coalesce(p, '') AS commercial_strategy,
            coalesce(fb, '') AS reviewer_feedback, status || ' (' || award_status || ')' AS outcome FROM g JOIN ident USING (proposal_id)""",
)
def proposal_summary(spark, sf):
    docs = listed(spark, sf, "document_role", "version_status", "include_in_clean_set", "include_in_future_rag")
    out = Y.proposal_summary(docs.withColumn("authority_rank", C.authority_rank()), identity(spark, sf, docs), "ord", texts(spark, sf))
    return out.withColumn("reviewer_feedback", F.array_join("reviewer_feedback", "|"))


@query(
    "evidence_refs",
    f"""{IDENTITY} SELECT proposal_id, 'tracker' AS source, NULL AS document_id, 'Tracker row ' || row_id || ' matches this group.' AS claim, CAST(0.9 AS DOUBLE) AS confidence
        FROM ident WHERE match_status = 'matched'
        UNION ALL SELECT proposal_id, 'document', arg_min(document_id, k), 'Surest name of a document: ' || arg_min(canonical_proposal_name, k), max(name_confidence)
        FROM (SELECT *, struct_pack(c := -name_confidence, o := ord) AS k FROM docs) GROUP BY 1""",
)
def evidence_refs(spark, sf):
    docs = listed(spark, sf, "document_id", "name_confidence")
    return Y.evidence_refs(docs, identity(spark, sf, docs), "ord")


ANSWERED = ("include_in_clean_set", "document_category", "status", "canonical_proposal_name", "rag_priority")
_ANSWERS = {"include_in_clean_set": ("yes", "No", "maybe", ""), "document_category": ("technical_data", "nonsense"), "status": ("awarded", "submitted", "won"), "rag_priority": ("high", "low", "?")}


def answers(docs: DataFrame) -> DataFrame:
    """Answers to a third of the documents, some to unknown ones, some of wrong kinds."""
    h, h2 = F.col("h"), F.col("h2")
    text = F.element_at(F.split(F.trim("summary_short"), " "), 1)
    for field, given in _ANSWERS.items():
        text = F.when(F.col("field") == field, X.pick(given, h2 % len(given))).otherwise(text)
    return (
        docs.where(h % 3 == 0).withColumn("field", X.pick((*ANSWERED, "secret_field"), F.floor(h / 3) % 6)).withColumn("user_answer", text)
        .select(
            F.when(h2 % 11 == 0, "doc_missing").otherwise(F.col("document_id")).alias("document_id"), "field", "user_answer",
            X.pick(("open", "skipped", "open"), F.col("doc_id") % 3).alias("status"), F.col("doc_id").alias("seq"),
        )
    )


_GIVEN = " ".join(f"WHEN '{f}' THEN {X._list(v)}[h2 % {len(v)} + 1]" for f, v in _ANSWERS.items())
_ALLOWED = {"document_category": rules.CATEGORIES, "status": rules.STATUSES, "rag_priority": rules.PRIORITIES}
CHECKED = f"""{LABELLED},
an0 AS (SELECT *, {X._list((*ANSWERED, "secret_field"))}[(h // 3) % 6 + 1] AS field FROM docs WHERE h % 3 = 0),
an1 AS (SELECT CASE WHEN h2 % 11 = 0 THEN 'doc_missing' ELSE document_id END AS document_id, field, trim(coalesce(CASE field {_GIVEN} ELSE string_split(trim(summary_short), ' ')[1] END, '')) AS a,
    ['open', 'skipped', 'open'][doc_id % 3 + 1] AS st, doc_id AS seq FROM an0),
an2 AS (SELECT *, a = '' OR st = 'skipped' AS skip, CASE field WHEN 'include_in_clean_set' THEN CASE WHEN lower(a) IN ('true', 'yes', 'y', '1') THEN 'true' WHEN lower(a) IN ('false', 'no', 'n', '0') THEN 'false' END
    {" ".join(f"WHEN '{f}' THEN CASE WHEN a IN {G._in(v)} THEN a END" for f, v in _ALLOWED.items())} WHEN 'canonical_proposal_name' THEN a END AS value FROM an1),
an3 AS (SELECT *, CASE WHEN skip THEN NULL WHEN document_id NOT IN (SELECT document_id FROM docs) THEN 'no such document'
    WHEN field = 'secret_field' THEN 'no answers are taken for this field: secret_field' WHEN value IS NOT NULL THEN NULL
    WHEN field = 'include_in_clean_set' THEN 'neither yes nor no: ' || a ELSE 'no value of ' || field || ': ' || a END AS error FROM an2),
an4 AS (SELECT *, CASE WHEN skip THEN 'skipped' WHEN error IS NULL THEN 'applied' ELSE 'invalid' END AS state FROM an3),
last AS (SELECT document_id, {", ".join(f"arg_max(value, seq) FILTER (field = '{f}') AS new_{f}" for f in ANSWERED)} FROM an4 WHERE state = 'applied' GROUP BY 1)
"""


def applied(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf)
    return N.apply_document_answers(docs, answers(docs), ANSWERED)


@query("answer_status", f"{CHECKED} SELECT seq, field, state, error FROM an4")
def answer_status(spark, sf):
    return applied(spark, sf)[1].select("seq", "field", "state", "error")


@query(
    "apply_document_answers",
    f"""{CHECKED} SELECT doc_id, coalesce(CAST(new_include_in_clean_set AS BOOLEAN), keep) AS include_in_clean_set, {", ".join(f"coalesce(new_{f}, {f}) AS {f}" for f in ANSWERED[1:])}
        FROM docs LEFT JOIN last USING (document_id)""",
)
def apply_document_answers(spark, sf):
    return applied(spark, sf)[0].select("doc_id", *ANSWERED)


_PATHS, _VALUES = ("proposal_context.Status", "document_identity.document_category", "version_status "), ("awarded", "technical_data", "final")


@query(
    "replay_overrides",
    f"""{LABELLED}, o AS (SELECT document_id, h2 % 3 AS k, doc_id AS seq FROM docs WHERE h % 4 = 1 AND h2 % 5 <> 0),
        l AS (SELECT document_id, bool_or(k = 0) AS s, bool_or(k = 1) AS c, bool_or(k = 2) AS v FROM o GROUP BY 1)
        SELECT doc_id, CASE WHEN s THEN 'awarded' ELSE status END AS status, CASE WHEN c THEN 'technical_data' ELSE document_category END AS document_category,
            CASE WHEN v THEN 'final' ELSE version_status END AS version_status FROM docs LEFT JOIN l USING (document_id)""",
)
def replay_overrides(spark, sf):
    docs = documents(spark, sf)
    log = docs.where("h % 4 = 1").select(
        X.pick(_PATHS, F.col("h2") % 3).alias("field"), X.pick(_VALUES, F.col("h2") % 3).alias("applied_value"), F.col("doc_id").alias("seq"),
        F.when(F.col("h2") % 5 == 0, "authoritative_document").otherwise("proposal_fact").alias("decision_type"), F.array("document_id").alias("affected_document_ids"),
    )
    fields = ("status", "document_category", "version_status")
    return N.replay_overrides(docs, log, fields).select("doc_id", *fields)


@query(
    "choose_authoritative",
    f"""{LABELLED}, c0 AS (SELECT proposal_id, document_role, max(document_id) AS chosen, min(doc_id) AS seq FROM docs GROUP BY ALL HAVING count(*) > 1),
        c AS (SELECT proposal_id, document_id, arg_max(chosen, struct_pack(s := seq, c := chosen)) AS chosen FROM docs JOIN c0 USING (proposal_id, document_role) GROUP BY ALL)
        SELECT doc_id, CASE WHEN chosen = document_id THEN 'authoritative' WHEN chosen IS NOT NULL AND authority_rank <> 'excluded' THEN 'supporting' ELSE authority_rank END AS authority_rank,
            CASE WHEN chosen = document_id THEN NULL WHEN chosen IS NOT NULL AND authority_rank <> 'excluded' THEN chosen ELSE superseded_by_document_id END AS superseded_by_document_id
        FROM lin LEFT JOIN c USING (proposal_id, document_id)""",
)
def choose_authoritative(spark, sf):
    """One choice for each role of a group. A content with several roles is in several choices; they are made in the order of
    their first files, and the last one counts."""
    docs = documents(spark, sf)
    groups = docs.groupBy("proposal_id", "document_role").agg(
        F.max("document_id").alias("chosen"), F.collect_set("document_id").alias("affected_document_ids"), F.count("*").alias("n"), F.min("doc_id").alias("seq")
    )
    choices = groups.where("n > 1").select("proposal_id", "chosen", "affected_document_ids", "seq")
    return N.choose_authoritative(C.lineage(docs), choices).select("doc_id", "authority_rank", "superseded_by_document_id")


FACTS = ("status", "agency", "canonical_proposal_name")
_FACT_FIELDS = ("proposal_context.Status", "agency", " canonical_proposal_name", "nickname", "")
_FACT_VALUES = {"status": ("awarded", "lost", "pending"), "agency": ("NSF", "DOE", "moon"), "canonical_proposal_name": ("First name", "Second name")}


def group_answers(docs: DataFrame) -> DataFrame:
    """Answers of group scope from a fourth of the documents: facts, choices, unknown groups, wrong kinds, skipped ones."""
    h, h2, choice = F.col("h"), F.col("h2"), F.col("decision_type") == "authoritative_document"
    text = F.lit("word")
    for field, given in _FACT_VALUES.items():
        text = F.when(F.col("field").ilike(f"%{field}"), X.pick(given, h2 % len(given))).otherwise(text)
    return (
        docs.where(h % 4 == 0).withColumn("field", X.pick(_FACT_FIELDS, F.floor(h / 4) % 5))
        .withColumn("decision_type", F.when(h2 % 7 == 0, "authoritative_document").otherwise("proposal_fact"))
        .select(
            F.when(h2 % 13 == 1, "p_missing").otherwise(F.col("proposal_id")).alias("proposal_id"), "field", "decision_type",
            F.array("document_id", F.lit("doc_unknown")).alias("affected_document_ids"),
            F.when(choice & (h2 % 2 == 0), F.col("document_id")).when(choice, "doc_other").otherwise(text).alias("user_answer"),
            X.pick(("open", "skipped", "answered", "open"), F.col("doc_id") % 4).alias("status"), F.col("doc_id").alias("seq"),
        )
    )


_FACT_GIVEN = " ".join(f"WHEN '{f}' THEN {X._list(v)}[h2 % {len(v)} + 1]" for f, v in _FACT_VALUES.items())
_FACT_ALLOWED = {"status": rules.STATUSES, "agency": rules.AGENCIES}
GROUP_ANSWERS = f"""{LABELLED}, own AS (SELECT proposal_id, {", ".join(f"min({f}) AS {f}" for f in FACTS)} FROM docs GROUP BY 1),
ga0 AS (SELECT *, {X._list(_FACT_FIELDS)}[(h // 4) % 5 + 1] AS gf, lower(trim(string_split({X._list(_FACT_FIELDS)}[(h // 4) % 5 + 1], '.')[-1])) AS fk, h2 % 7 = 0 AS choice FROM docs WHERE h % 4 = 0),
ga1 AS (SELECT CASE WHEN h2 % 13 = 1 THEN 'p_missing' ELSE proposal_id END AS proposal_id, fk, trim(gf) AS gf, choice, document_id, doc_id AS seq, doc_id % 4 = 1 AS skip,
    CASE WHEN choice THEN CASE WHEN h2 % 2 = 0 THEN document_id ELSE 'doc_other' END ELSE CASE fk {_FACT_GIVEN} ELSE 'word' END END AS a FROM ga0),
ga2 AS (SELECT *, CASE WHEN skip THEN NULL WHEN proposal_id IS NULL OR proposal_id NOT IN (SELECT proposal_id FROM own WHERE proposal_id IS NOT NULL) THEN 'no such group'
    WHEN gf = '' THEN 'the answer names no field'
    WHEN choice THEN CASE WHEN a = 'doc_other' THEN 'not among the documents asked about: ' || document_id || ', doc_unknown' END
    WHEN fk = 'nickname' THEN 'groups take no answers for: nickname'
    {" ".join(f"WHEN fk = '{f}' AND a NOT IN {G._in(v)} THEN 'no value of {f}: ' || a" for f, v in _FACT_ALLOWED.items())} END AS error FROM ga1),
ga3 AS (SELECT *, CASE WHEN skip THEN 'skipped' WHEN error IS NULL THEN 'applied' ELSE 'invalid' END AS state FROM ga2),
facts AS (SELECT *, lag(a) OVER (PARTITION BY proposal_id, fk ORDER BY seq) AS before FROM ga3 WHERE state = 'applied' AND NOT choice)
"""


def group_applied(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    docs = documents(spark, sf)
    groups = docs.groupBy("proposal_id").agg(*(F.min(f).alias(f) for f in FACTS))
    return N.apply_proposal_answers(groups, docs, C.lineage(docs), group_answers(docs), FACTS)


def _last(key: str) -> str:
    return f"SELECT {key}, {', '.join(f"arg_max(a, seq) FILTER (fk = '{f}') AS new_{f}" for f in FACTS)} FROM facts GROUP BY 1"


@query(
    "apply_proposal_answers",
    f"""{GROUP_ANSWERS}, g AS ({_last("proposal_id")})
        SELECT proposal_id, {", ".join(f"coalesce(new_{f}, {f}) AS {f}" for f in FACTS)} FROM own LEFT JOIN g USING (proposal_id)""",
)
def apply_proposal_answers(spark, sf):
    return group_applied(spark, sf)[0]


@query(
    "affected_documents",
    f"""{GROUP_ANSWERS}, g AS ({_last("document_id")})
        SELECT doc_id, {", ".join(f"coalesce(new_{f}, {f}) AS {f}" for f in FACTS)} FROM docs LEFT JOIN g USING (document_id)""",
)
def affected_documents(spark, sf):
    return group_applied(spark, sf)[1].select("doc_id", *FACTS)


@query(
    "proposal_answer_log",
    f"""{GROUP_ANSWERS} SELECT seq, ga3.fk AS field, ga3.state, ga3.error, CASE WHEN ga3.state = 'applied' THEN ga3.a END AS applied_value,
            CASE WHEN facts.seq IS NOT NULL THEN coalesce(before, CASE ga3.fk {" ".join(f"WHEN '{f}' THEN own.{f}" for f in FACTS)} END) END AS previous_value
        FROM ga3 LEFT JOIN facts USING (seq) LEFT JOIN own ON own.proposal_id = ga3.proposal_id""",
)
def proposal_answer_log(spark, sf):
    value = F.when(F.col("state") == "applied", F.col("value")).alias("applied_value")
    return group_applied(spark, sf)[3].select("seq", "field", "state", "error", value, "previous_value")


@query(
    "clear_uncertainties",
    f"""{GROUP_ANSWERS}, u AS (SELECT document_id, unnest(['proposal_context.status', 'Agency ', 'partners']) AS field FROM docs WHERE h % 3 <> 1)
        SELECT document_id, field FROM u WHERE NOT EXISTS (FROM facts WHERE facts.document_id = u.document_id AND fk = lower(trim(string_split(u.field, '.')[-1])))""",
)
def clear_uncertainties(spark, sf):
    docs = documents(spark, sf)
    named = F.explode(F.array(*map(F.lit, ("proposal_context.status", "Agency ", "partners")))).alias("field")
    return N.clear_uncertainties(docs.where("h % 3 <> 1").select("document_id", named), group_applied(spark, sf)[3])


def _asked(guess: str) -> str:
    return f"trim('Which ' || field || ' holds for Group ' || group_id || ' (' || group_id || ')?' || coalesce(' So far it looks like ''' || nullif({guess}, '') || '''.', '') || ' ')"


@query(
    "build_questions",
    f"""{DECIDED}, {OVERRIDES}, r AS (SELECT dec.*, applied_value FROM dec LEFT JOIN ovr USING (group_id, field_key))
        SELECT question_id, group_id, field, {_asked("guess")} AS question, ['low', 'medium', 'high', 'critical'][impact + 1] AS priority,
            CASE WHEN field_key = 'view' THEN 'a | b' END AS suggested_options, CASE field_key WHEN 'view' THEN 'enum' WHEN 'click' THEN 'list' ELSE 'string' END AS answer_type,
            CASE WHEN applied_value IS NOT NULL THEN 'Asked again, since documents now say otherwise. ' ELSE '' END || 'The documents leave it open.' AS why
        FROM r WHERE applied_value IS NULL OR NOT (guess IS NULL OR guess = applied_value)""",
)
def build_questions(spark, sf):
    resolved = D.resolve_by_override(G.decisions(spark, sf), G.overrides(spark, sf))
    return K.build_questions(resolved, {"view": ("b", "a"), "click": "list"})


BUILT = G.ORACLES["build_questions"]


@query(
    "refine_questions",
    f"""WITH q AS ({BUILT}), k AS (SELECT *, group_id % 5 AS g, (g = 3 AND priority IN ('high', 'critical')) OR g = 4 AS hit FROM q)
        SELECT question_id, group_id, CASE WHEN g = 3 AND hit THEN 'Reworded: ' || question ELSE question END AS question,
            CASE WHEN g = 4 THEN 'x | y' ELSE suggested_options END AS suggested_options, why
        FROM k QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY group_id)""",
)
def refine_questions(spark, sf):
    """Of five groups one gets no response, one unknown ids, one no list, one a choice in new words, one new options."""
    asked, g = build_questions(spark, sf), F.col("group_id") % 5
    name = F.when(g == 1, F.concat(F.lit("other_"), "question_id")).otherwise(F.col("question_id"))
    words = F.when(g == 3, F.concat(F.lit(" Reworded: "), "question")).otherwise("  ")
    item = F.to_json(F.struct(name.alias("question_id"), words.alias("question"), F.when(g == 4, "x | y ").alias("suggested_options")))
    kept = asked.where((g != 0) & ((g != 3) | F.col("priority").isin("high", "critical"))).select("group_id", item.alias("item"))
    listed = kept.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("items"))
    body = F.when(g == 2, '{"questions": "none"}').otherwise(F.concat(F.lit('{"questions": ["noise", 7, '), "items", F.lit("]}")))
    return K.refine_questions(asked, listed.select("group_id", body.alias("body"))).select("question_id", "group_id", "question", "suggested_options", "why")


@query(
    "export_questions",
    f"""{DECIDED}, {X.INVENTORY_SQL}, {DECKS},
        r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY impact DESC, question_id) AS n FROM dec WHERE impact > 0),
        q AS (SELECT question_id, CAST(group_id AS VARCHAR) AS owner, ['low', 'medium', 'high', 'critical'][impact + 1] AS priority FROM r WHERE n <= 3 ORDER BY impact DESC, group_id, question_id LIMIT 20),
        e AS (SELECT *, 0 AS source FROM q UNION ALL SELECT 'q_' || left(sha256(relative_path), 8), document_id, 'medium', 1 FROM decks WHERE pdf IS NULL),
        f AS (SELECT question_id, min(struct_pack(s := source, o := owner, p := priority)) AS r FROM e GROUP BY 1)
        SELECT question_id, r.o AS owner, r.p AS priority FROM f""",
)
def export_questions(spark, sf):
    level = F.element_at(F.array(*map(F.lit, K.PRIORITIES)), F.col("impact") + 1)
    asked = D.arbitrate(G.decisions(spark, sf)).select("question_id", F.col("group_id").cast("string").alias("owner"), level.alias("priority"))
    decks = I.slide_questions(X.inventory(spark, sf)).select("question_id", F.col("document_id").alias("owner"), "priority")
    return K.export_questions([asked, decks])


@query(
    "open_critical",
    f"""{LABELLED}, q AS (SELECT 'q_' || left(sha256(document_id || '|' || f), 12) AS question_id, * FROM (SELECT *, ['status', 'agency'][h2 % 2 + 1] AS f FROM docs)),
        rv AS (SELECT *, lower(trim(['open', 'applied', 'skipped', 'OPEN '][h2 % 4 + 1])) AS s FROM q WHERE h % 8 = 0 OR h % 5 = 1),
        ap AS (SELECT question_id FROM q WHERE h % 32 = 0),
        al AS (SELECT 0 AS src, question_id, proposal_id, f FROM q WHERE h % 4 = 0 AND h2 % 3 = 0 AND question_id NOT IN (SELECT question_id FROM rv WHERE s IN ('applied', 'skipped'))
                AND question_id NOT IN (FROM ap)
            UNION ALL SELECT 1, question_id, proposal_id, f FROM rv WHERE s NOT IN ('applied', 'skipped') AND question_id NOT IN (FROM ap)
            UNION ALL SELECT 2, question_id, proposal_id, f FROM q WHERE h % 7 = 0 AND question_id NOT IN (SELECT question_id FROM q WHERE h2 % 5 = 0))
        SELECT question_id, arg_min(proposal_id, struct_pack(s := src, p := proposal_id, f := f)) AS proposal_id, arg_min(f, struct_pack(s := src, p := proposal_id, f := f)) AS field
        FROM al GROUP BY 1""",
)
def open_critical(spark, sf):
    docs = documents(spark, sf).withColumn("field", X.pick(("status", "agency"), F.col("h2") % 2))
    q = docs.withColumn("question_id", F.concat(F.lit("q_"), F.substring(F.sha2(F.concat_ws("|", "document_id", "field"), 256), 1, 12)))
    own = q.where("h % 4 = 0").withColumn("priority", F.when(F.col("h2") % 3 == 0, "critical").otherwise("low"))
    review = q.where("h % 8 = 0 or h % 5 = 1").withColumn("priority", F.lit("Critical")).withColumn("status", X.pick(("open", "applied", "skipped", "OPEN "), F.col("h2") % 4))
    arbitrated = q.where("h % 7 = 0").withColumn("priority", F.lit("critical"))
    return K.open_critical([own, arbitrated], review, q.where("h % 32 = 0"), q.where("h2 % 5 = 0"))


@query(
    "missing_sources",
    f"""{LABELLED} SELECT document_id, relative_path, 'source_file_missing' AS reason FROM docs
        WHERE relative_path NOT IN (SELECT relative_path FROM inventory WHERE size_bytes % 3 <> 0)""",
)
def missing_sources(spark, sf):
    return K.missing_sources(documents(spark, sf), X.inventory(spark, sf).where("size_bytes % 3 <> 0"))


_TREATED = G.ORACLES["knowledge_base_treatment"].removeprefix(LABELLED)


@query(
    "document_manifest",
    f"""{PLANNED}, kb AS ({_TREATED})
        SELECT docs.doc_id, docs.document_id, docs.proposal_id, file_name_original, document_role, version_status, rag_priority,
            CASE WHEN h2 % 4 <> 0 THEN lin.authority_rank ELSE 'supporting' END AS authority_rank, CASE WHEN h2 % 4 <> 0 THEN superseded_by_document_id END AS superseded_by_document_id,
            h2 % 4 <> 0 AND contains_unique_reasoning AS contains_unique_reasoning, CASE WHEN h2 % 4 <> 0 THEN recommended_treatment ELSE 'metadata_only' END AS recommended_treatment, clean_path
        FROM docs JOIN (SELECT doc_id, authority_rank, superseded_by_document_id, contains_unique_reasoning FROM lin) lin USING (doc_id) JOIN kb USING (doc_id)
        LEFT JOIN (SELECT doc_id, clean_path FROM plan) USING (doc_id)""",
)
def document_manifest(spark, sf):
    docs = documents(spark, sf)
    return K.document_manifest(docs, C.treatments(C.lineage(docs.where("h2 % 4 <> 0 or true"))).where("h2 % 4 <> 0"), S.plan_clean_set(docs))


FOLDERS = f"""{IDENTITY}, dc AS (SELECT proposal_id, count(*) AS n_documents, count(*) FILTER (keep) AS n_included, count(*) FILTER (personal) AS n_review,
    count(*) FILTER (personal OR budget) AS n_sensitive FROM docs GROUP BY 1),
qd AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY ord) AS n FROM docs WHERE keep),
ql AS (SELECT proposal_id, string_agg('**' || file_name_original || '**: ' || trim(summary_short), chr(10) || chr(10) ORDER BY n) AS summary_detailed
    FROM qd WHERE n <= 5 AND trim(summary_short) <> '' GROUP BY 1),
ro AS (SELECT proposal_id, string_agg('- ' || document_role || ': ' || n, chr(10) ORDER BY document_role) AS roles FROM (SELECT proposal_id, document_role, count(*) AS n FROM docs GROUP BY ALL) GROUP BY 1),
folders AS (SELECT *, proposal_name || ': ' || program || ' application to ' || agency || ', ' || status || '; documents kept: ' || n_included AS summary_sentence
    FROM ident JOIN dc USING (proposal_id) LEFT JOIN ql USING (proposal_id) JOIN ro USING (proposal_id))
"""


def folders(spark: SparkSession, sf: str) -> DataFrame:
    more = ("document_role", "include_in_clean_set", "manual_review_required", "contains_personal_info", "contains_budget_or_rates")
    docs = listed(spark, sf, *more).withColumn("sensitive", F.col("contains_personal_info") | F.col("contains_budget_or_rates"))
    return K.folder_records(docs, identity(spark, sf, docs), "ord", texts(spark, sf))


@query(
    "build_folders",
    f"""{FOLDERS} SELECT proposal_id, proposal_name, status, award_status, n_documents, n_included, n_review, n_sensitive, summary_sentence,
        coalesce(summary_detailed, '') AS summary_detailed FROM folders""",
)
def build_folders(spark, sf):
    return folders(spark, sf).select(
        "proposal_id", "proposal_name", "status", "award_status", "n_documents", "n_included", "n_review", "n_sensitive", "summary_sentence", "summary_detailed"
    )


@query(
    "folder_markdown",
    f"""{FOLDERS} SELECT proposal_id, concat_ws(chr(10) || chr(10), '# ' || proposal_name, '**Group:** ' || proposal_id, '**Agency:** ' || agency || ' | **Program:** ' || program,
        '**Status:** ' || status || ' | **Award:** ' || award_status, '**Submitted:** ' || submission_date, '**Lead:** ' || lead_organization,
        CASE WHEN len(partners) > 0 THEN '**Partners:** ' || array_to_string(partners[1:10], ', ') END, '## Summary', summary_sentence, nullif(summary_detailed, ''), '## Roles', roles) AS markdown FROM folders""",
)
def folder_markdown(spark, sf):
    return K.folder_markdown(folders(spark, sf))


@query(
    "retrieval_record",
    f"""{LABELLED} SELECT proposal_id, concat_ws(',', CASE WHEN bool_or(budget) THEN 'budget_or_rates' END, CASE WHEN bool_or(personal) THEN 'personal_info' END) AS labels_present,
        count(*) FILTER (personal) AS manual_review_required_count, {", ".join(f"count(*) FILTER (rag_priority = '{p}') AS n_{p}" for p in ("high", "medium", "low", "exclude"))},
        count(*) AS document_count FROM docs GROUP BY 1""",
)
def retrieval_record(spark, sf):
    return K.retrieval_summary(documents(spark, sf)).withColumn("labels_present", F.array_join("labels_present", ","))


@query(
    "evaluate_expectations",
    f"""{IDENTITY}, ar AS (SELECT proposal_id, string_agg(DISTINCT document_role, ' ' ORDER BY document_role) AS roles FROM docs WHERE authority_rank = 'authoritative' GROUP BY 1),
        e AS (SELECT DISTINCT proposal_branch FROM docs UNION ALL SELECT 'Nowhere')
        SELECT e.proposal_branch, CASE WHEN proposal_id IS NULL THEN 'not synthesised' ELSE concat_ws('; ', CASE WHEN status <> 'awarded' THEN 'status: expected awarded, got ' || status END,
            CASE WHEN document_count <> 10 THEN 'document_count: expected 10, got ' || document_count END,
            CASE WHEN coalesce(roles, '') <> 'technical_volume' THEN 'authoritative_roles: expected technical_volume, got ' || coalesce(roles, '') END) END AS mismatches
        FROM e LEFT JOIN ident USING (proposal_branch) LEFT JOIN ar USING (proposal_id)""",
)
def evaluate_expectations(spark, sf):
    docs = listed(spark, sf, "document_role", "version_status", "include_in_clean_set", "include_in_future_rag")
    nothing = F.lit(None).cast("string")
    nowhere = spark.range(1).select(F.lit("Nowhere").alias("proposal_branch"))
    expected = docs.select("proposal_branch").distinct().union(nowhere).select(
        "proposal_branch", F.lit("awarded").alias("status"), nothing.alias("award_status"), nothing.alias("agency"), nothing.alias("program"),
        F.lit(10).alias("document_count"), F.array(F.lit("technical_volume")).alias("authoritative_roles"),
    )
    roles = docs.where(C.authority_rank() == "authoritative").select("proposal_id", "document_role")
    return K.evaluate_expectations(identity(spark, sf, docs), roles, expected).withColumn("mismatches", F.array_join("mismatches", "; "))


@query(
    "stage_counts",
    f"""WITH r AS ({G.ORACLES["resume_status"]}), a AS ({G.ORACLES["arbitration_counts"]})
        SELECT 'run1' AS run_id, 'analyze' AS stage, unnest(['total', 'eligible', 'processed', 'pending', 'failed_pending']) AS metric, unnest([total, eligible, processed, pending, failed_pending]) AS value FROM r
        UNION ALL SELECT 'run1', 'arbitrate', unnest(['total', 'low', 'exported', 'suppressed']), unnest([total, low, exported, suppressed]) FROM a""",
)
def stage_counts(spark, sf):
    return K.stage_counts("run1", {"analyze": G.resume_status(spark, sf), "arbitrate": D.arbitration_counts(G.decisions(spark, sf))})


@query(
    "request_packets",
    f"""{IDENTITY}, n AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY ord) AS n FROM docs),
        p AS (SELECT proposal_id, '[' || string_agg('{{"document_id":"' || document_id || '","role":"' || document_role || '"}}', ',' ORDER BY n) || ']' AS d FROM n GROUP BY 1)
        SELECT proposal_id, '{{"proposal_name":"' || proposal_name || '","status":"' || status || '","documents":' || d || '}}' AS payload FROM ident JOIN p USING (proposal_id)""",
)
def request_packets(spark, sf):
    docs = listed(spark, sf, "document_id", "document_role")
    return K.request_packets(docs, identity(spark, sf, docs), "ord")


@query(
    "inclusion_rule",
    f"""{LABELLED} SELECT doc_id, concat_ws(',', CASE WHEN keep AND include_reason IS NULL THEN 'include_reason' END, CASE WHEN NOT keep AND exclude_reason IS NULL THEN 'exclude_reason' END) AS broken FROM docs""",
)
def inclusion_rule(spark, sf):
    return R.with_violations(documents(spark, sf), R.inclusion_checks()).select("doc_id", F.array_join("violations", ",").alias("broken"))


def forms(spark: SparkSession, sf: str) -> DataFrame:
    """Responses in the forms that models give partners, risks and questions, made of each document's words."""
    docs = X.table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), 0).alias("w"))
    word = [F.coalesce(F.get("w", F.lit(i)), F.lit("")) for i in range(6)]
    body = F.format_string(
        '{"document_id": "made up", "proposal_context": {"partners": ["%s", {"name": " %s "}, {"city": "%s"}, {"company": ""}, 7]}, "content": {"risks": '
        '[{"risk": "%s", "date": "%s"}, {"x": "%s"}, "  ", null]}, "uncertainties": [{"field": "f", "confidence": 0.25}], "questions_for_user": '
        '[{"field": "", "question": "%s?", "notes": "%s", "priority": "High", "model_guess": "%s"}, {"priority": "?"}]}',
        *word, *word[:3],
    )
    return docs.select("doc_id", body.alias("body"), F.lit("made up").alias("document_id"), F.lit("none").alias("sha256"))


_WORDS = "WITH f AS (SELECT doc_id, " + ", ".join(f"coalesce(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')[{i + 1}], '') AS w{i}" for i in range(6)) + " FROM documents)"


@query(
    "normalize_lists",
    f"""{_WORDS} SELECT doc_id, concat_ws('|', nullif(w0, ''), nullif(w1, ''), nullif(w2, '')) AS partners,
        concat_ws('|', nullif(concat_ws(' - ', nullif(w3, ''), nullif(w4, '')), ''), nullif(w5, '')) AS risks FROM f""",
)
def normalize_lists(spark, sf):
    made = forms(spark, sf)
    return made.select("doc_id", F.array_join(R.partners(F.col("body")), "|").alias("partners"), F.array_join(R.list_items(F.col("body"), "risks"), "|").alias("risks"))


@query(
    "fold_legacy_questions",
    f"""{_WORDS} SELECT doc_id, 'f' AS field, NULL AS current_guess, CAST(0.25 AS DOUBLE) AS confidence, NULL AS downstream_impact, NULL AS reason_unresolved FROM f
        UNION ALL SELECT doc_id, 'unknown', w2, 0.5, 'high', concat_ws(' ', w0 || '?', nullif(w1, '')) FROM f
        UNION ALL SELECT doc_id, 'unknown', NULL, 0.5, 'low', 'A question of the older form.' FROM f""",
)
def fold_legacy_questions(spark, sf):
    found = forms(spark, sf).select("doc_id", F.explode(R.uncertainties(F.col("body"))).alias("u"))
    return found.select("doc_id", "u.field", "u.current_guess", "u.confidence", "u.downstream_impact", "u.reason_unresolved")


@query("inject_system_fields", f"{INV} SELECT doc_id, document_id, sha256, proposal_id FROM inventory WHERE sha256[1:1] <> '7'")
def inject_system_fields(spark, sf):
    """Responses that name their document rightly, wrongly or not at all, that are missing, or are about no document."""
    inv, first = X.inventory(spark, sf), F.substring("sha256", 1, 1)
    said = F.when(first < "4", F.col("document_id")).when(first < "c", "made up")
    about = F.when(first == "7", -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    responses = inv.select(about.alias("doc_id"), said.alias("document_id"), F.reverse("sha256").alias("sha256"), F.lit("none").alias("proposal_id"))
    return R.system_fields(responses, inv, ("document_id", "sha256", "proposal_id")).select("doc_id", "document_id", "sha256", "proposal_id")


@query(
    "closed_record",
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
        SELECT doc_id, concat_ws(',', CASE WHEN h[1:1] < '6' OR h[2:2] < '4' THEN 'required' END, CASE WHEN h[3:3] < '5' THEN 'closed' END) AS broken FROM h""",
)
def closed_record(spark, sf):
    """Records that lack a field they must have, or have one they may not, by the hash of the whole text."""
    digit = lambda i: F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), i, 1)
    body = F.to_json(
        F.struct(
            F.when(digit(1) >= "6", F.col("doc_id").cast("string")).alias("document_id"), F.when(digit(2) >= "4", "1").alias("schema_version"),
            F.when(digit(4) < "8", F.col("text")).alias("content"), F.when(digit(3) < "5", F.col("doc_id")).alias("extra"),
        )
    )
    checks = R.closed_record(F.col("body"), ("document_id", "schema_version", "content", "uncertainties"), ("document_id", "schema_version"))
    return R.with_violations(X.table(spark, sf, "documents").withColumn("body", body), checks).select("doc_id", F.array_join("violations", ",").alias("broken"))


@query(
    "size_limit_errors",
    """SELECT event_id, event_id % 2 = 0 AND event_type IN ('error', 'view') AS retry FROM events""",
)
def size_limit_errors(spark, sf):
    kind = F.col("event_type")
    message = F.when(kind == "error", "Above the Maximum document size").when(kind == "view", "A maximum of 100 PDF pages").otherwise(F.concat(kind, F.lit(" maximum")))
    strategy = F.when(F.col("event_id") % 2 == 0, "direct_bedrock").otherwise("local_extract_then_bedrock")
    return X.table(spark, sf, "events").select("event_id", T.size_limit_error(strategy, message).alias("retry"))


@query("latency_seconds", "SELECT event_id, CAST(round(value) AS BIGINT) / 1000.0::DOUBLE AS seconds, strftime(ts, '%Y-%m-%d') AS day FROM events")
def latency(spark, sf):
    events = X.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("until", F.col("ts") + F.make_dt_interval(secs=(F.round("value").cast("long") / 1000).cast("decimal(18,6)")))
    stamp = F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd"), F.lit("T10:00:00 "))
    return events.select("event_id", T.latency_seconds(F.col("ts"), F.col("until")).alias("seconds"), T.iso_date(stamp).alias("day"))


@query(
    "parse_options",
    """WITH f AS (SELECT doc_id, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM documents)
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'true|false' ELSE concat_ws('|', nullif(l, ''), nullif(s, '')) END AS options FROM f""",
)
def parse_options(spark, sf):
    m, lang, source = F.col("doc_id") % 4, F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    given = (
        F.when(m == 0, " ").when(m == 1, F.format_string('["%s", " %s ", ""]', lang, source))
        .when(m == 2, F.format_string("[%s, '%s']", lang, source)).otherwise(F.format_string("%s | %s,", lang, source))
    )
    return X.table(spark, sf, "documents").select("doc_id", F.array_join(N.parse_options(given, F.when(m == 0, "Boolean").otherwise("list")), "|").alias("options"))


@query("scan_branch", f"{INV} SELECT doc_id, relative_path FROM inventory WHERE year_folder = '2020' AND starts_with(proposal_branch, '2020 NSF')")
def scan_branch(spark, sf):
    return I.in_groups(X.inventory(spark, sf)).where(F.col("year_folder") == "2020").where(F.col("proposal_branch").startswith("2020 NSF")).select("doc_id", "relative_path")


@query(
    "latest_run",
    """WITH r AS (SELECT *, 'run_' || lpad(CAST(user_id % 7 AS VARCHAR), 3, '0') AS run_id FROM events) SELECT event_id, run_id FROM r WHERE run_id = (SELECT max(run_id) FROM r)""",
)
def latest_run(spark, sf):
    run = F.concat(F.lit("run_"), F.lpad((F.col("user_id") % 7).cast("string"), 3, "0"))
    return K.latest_run(X.table(spark, sf, "events").select("event_id", run.alias("run_id")))


@query(
    "run_manifest",
    "SELECT user_id AS run_id, arg_max(event_type, event_id) AS command FROM events GROUP BY 1",
)
def run_manifest(spark, sf):
    log = X.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("command"))
    return K.run_manifest(log).drop("seq")


@query(
    "review_pass2",
    f"""{LABELLED}, o AS (SELECT x.doc_id, y.agency AS v, count(*) AS n, min(y.ord) AS o FROM docs x JOIN docs y ON x.proposal_id = y.proposal_id AND x.doc_id <> y.doc_id AND y.agency <> 'unknown' GROUP BY ALL),
        b AS (SELECT doc_id, arg_min(v, struct_pack(a := -n, b := o)) AS suggested FROM o GROUP BY 1),
        m AS (SELECT *, contains(lower(file_name_original), 'support letter') OR document_role IN ('letter_of_support', 'unknown') AS letter FROM docs LEFT JOIN b USING (doc_id))
        SELECT doc_id, CASE WHEN letter THEN 'partner_document' ELSE document_category END AS document_category, CASE WHEN letter THEN 'letter_of_support' ELSE document_role END AS document_role,
            CASE WHEN letter THEN greatest(category_confidence, 0.92) ELSE category_confidence END AS category_confidence, CASE WHEN agency = 'unknown' THEN coalesce(suggested, agency) ELSE agency END AS agency,
            CASE WHEN canonical_proposal_name = 'unknown' THEN proposal_branch ELSE canonical_proposal_name END AS canonical_proposal_name, greatest(name_confidence, 0.9) AS name_confidence FROM m""",
)
def review_pass2(spark, sf):
    docs = P.branch_signals(documents(spark, sf), "agency", "ord").withColumnRenamed("suggested", "suggested_agency")
    docs = docs.withColumns({"suggested_program": F.lit(None).cast("string"), "suggested_canonical_proposal_name": F.lit("unknown")})
    return P.review_again(docs).select("doc_id", "document_category", "document_role", "category_confidence", "agency", "canonical_proposal_name", "name_confidence")


@query(
    "synthesize_proposals",
    f"""{IDENTITY} SELECT proposal_id, CASE WHEN status = 'awarded' THEN 'Model of ' || proposal_name ELSE proposal_name END AS proposal_name,
        CASE WHEN status = 'awarded' THEN 'model' ELSE 'deterministic_fallback' END AS synthesis_source FROM ident""",
)
def synthesize_proposals(spark, sf):
    from foliant.plans.run import synthesize

    own = W.stored(identity(spark, sf))
    model = own.where("status in ('awarded', 'drafted')").select(
        "proposal_id", F.concat(F.lit("Model of "), "proposal_name").alias("proposal_name"), (F.col("status") == "awarded").alias("valid")
    )
    return synthesize(own, model, ("proposal_name",)).select("proposal_id", "proposal_name", "synthesis_source")
