"""Queries of windows over usage, rule tables, sinks and orders, profiles, second passes, reports and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import rules
from foliant.operators import classify as C
from foliant.operators import decisions as D
from foliant.operators import inventory as I
from foliant.operators import profiles as O
from foliant.operators import reports as P
from foliant.operators import rule_tables as U
from foliant.operators import second_pass as Z
from foliant.operators import tracker as M
from foliant.plans.records import MATCHED, TOKENS
from foliant.plans.registry import CLASSED, INV, KEY_ROLES, LABELLED, USAGE, _in, _ORDER, _rule_sql, documents, query, usage
from foliant.sources import fixtures as X
from foliant.sources import tables as S
from foliant.streaming import jobs as J

KINDS = ("tumbling", "sliding", "session")


@query(
    "usage_windows",
    f"""{USAGE}, t AS (SELECT *, date_trunc('day', ts) AS a, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM u),
        w AS (SELECT 'tumbling' AS kind, user_id, a AS "start", a + INTERVAL 1 DAY AS "end", total_tokens, success FROM t
            UNION ALL SELECT 'sliding', user_id, b - i * INTERVAL 6 HOUR, b - i * INTERVAL 6 HOUR + INTERVAL 1 DAY, total_tokens, success FROM t, (SELECT unnest([0, 1, 2, 3]) AS i)),
        g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM t),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
        SELECT kind, user_id, "start", "end", CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS calls, count(*) FILTER (NOT success) AS failures
        FROM w GROUP BY ALL
        UNION ALL SELECT 'session', user_id, min(ts), max(ts) + INTERVAL 30 MINUTE, CAST(sum(total_tokens) AS BIGINT), count(*), count(*) FILTER (NOT success)
        FROM s GROUP BY user_id, n""",
)
def usage_windows(spark, sf):
    rows, out = usage(spark, sf), None
    for kind in KINDS:
        more = J.usage_windows(rows, kind)
        out = more if out is None else out.unionByName(more)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "usage_late_rows",
    f"""{USAGE}, a AS (SELECT *, event_id // 500 + CASE WHEN event_id % 37 = 0 THEN 4 ELSE 0 END AS batch FROM u),
        m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS mark FROM a GROUP BY batch),
        k AS (SELECT batch, ts, mark, unnest(['tumbling', 'sliding', 'session']) AS kind FROM a JOIN m USING (batch)),
        e AS (SELECT *, CASE kind WHEN 'tumbling' THEN date_trunc('day', ts) + INTERVAL 1 DAY WHEN 'sliding' THEN time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 1 DAY
            ELSE ts + INTERVAL 30 MINUTE END AS closes FROM k)
        SELECT kind, batch, count(*) AS n, count(*) FILTER (coalesce(closes <= mark, false)) AS n_late FROM e GROUP BY ALL""",
)
def usage_late_rows(spark, sf):
    batch = F.floor(F.col("event_id") / 500) + F.when(F.col("event_id") % 37 == 0, 4).otherwise(0)
    rows, out = usage(spark, sf).withColumn("batch", batch), None
    for kind in KINDS:
        more = J.with_lateness(rows, "batch", "1 day", kind).groupBy(F.lit(kind).alias("kind"), "batch").agg(F.count("*").alias("n"), F.count_if("is_late").alias("n_late"))
        out = more if out is None else out.unionByName(more)
    return out


RULE_SETS = {"category": rules.CATEGORY_RULES, "role": rules.ROLE_RULES, "version": rules.VERSION_RULES}


def rule_table(spark: SparkSession) -> DataFrame:
    """The classifier's rule chains as a table."""
    rows = [(name, i, word, value) for name, chain in RULE_SETS.items() for i, (words, value) in enumerate(chain) for word in words]
    return spark.createDataFrame(rows, "rule_set string, ordinal int, keyword string, value string")


@query(
    "rule_table_classes",
    f"""{INV} SELECT doc_id, {_rule_sql("stem", rules.CATEGORY_RULES, "NULL")} AS category, {_rule_sql("stem", rules.ROLE_RULES, "NULL")} AS role,
        {_rule_sql("stem", rules.VERSION_RULES, "NULL")} AS version FROM inventory""",
)
def rule_table_classes(spark, sf):
    found = U.apply_rules(X.inventory(spark, sf), "stem", rule_table(spark))
    return found.select("doc_id", *(F.try_element_at("matched", F.lit(s)).alias(s) for s in RULE_SETS))


@query(
    "keyword_rules",
    r"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{7,}'))) AS k FROM benchmark),
        n AS (SELECT k, row_number() OVER (ORDER BY reverse(k), k) AS o FROM w),
        f AS (SELECT doc_id, CASE WHEN o % 2 = 0 THEN 'even' ELSE 'odd' END AS rule_set, arg_min(k, o) AS value FROM documents JOIN n ON contains(lower(text), k) GROUP BY ALL)
        SELECT doc_id, max(value) FILTER (rule_set = 'even') AS even, max(value) FILTER (rule_set = 'odd') AS odd
        FROM (SELECT doc_id FROM documents) LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
)
def keyword_rules(spark, sf):
    """All longer words of the benchmark as rules of two sets, over whole texts."""
    words = X.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{7,})"))).alias("k"))
    keys = words.select(F.lower("k").alias("keyword")).distinct().select("keyword", F.reverse("keyword").alias("o"))
    path = S.new_path(spark)
    S.write_ordered(keys, path, "o", "keyword")
    place = F.col("position")
    table = S.read_ordered(spark, path).select(F.when(place % 2 == 0, "even").otherwise("odd").alias("rule_set"), place.alias("ordinal"), "keyword", F.col("keyword").alias("value"))
    found = U.apply_rules(X.table(spark, sf, "documents"), "text", table)
    return found.select("doc_id", *(F.try_element_at("matched", F.lit(s)).alias(s) for s in ("even", "odd")))


def _lower(c: str) -> str:
    return f"lower(coalesce({c}, ''))"


#: Orders in which tables are handed over: documents, exclusions, questions, decisions.
OUTPUT_ORDERS = {
    "documents": ("year_folder", _lower("proposal_branch"), _lower("relative_path"), "doc_id"),
    "exclusions": ("proposal_id", "relative_path", "doc_id"),
    "questions": ("proposal_id", "coalesce(file_name_original, '')", "doc_id"),
    "decisions": ("document_id", "doc_id"),
}


@query(
    "output_orders",
    f"{INV} " + " UNION ALL ".join(f"SELECT '{n}' AS kind, doc_id, row_number() OVER (ORDER BY {', '.join(o)}) AS position FROM inventory" for n, o in OUTPUT_ORDERS.items()),
)
def output_orders(spark, sf):
    out = None
    for kind, order in OUTPUT_ORDERS.items():
        path = S.new_path(spark)
        S.write_ordered(X.inventory(spark, sf).drop("summary_short", "summary_detailed"), path, *map(F.expr, order))
        more = S.read_ordered(spark, path).select(F.lit(kind).alias("kind"), "doc_id", "position")
        out = more if out is None else out.unionByName(more)
    return out


@query(
    "write_table",
    f"""{INV} SELECT 'r1' AS run_id, CAST(1 + doc_id % 2 AS INTEGER) AS pass_number, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM inventory GROUP BY 2
        UNION ALL SELECT 'r2', CAST(1 + doc_id % 2 AS INTEGER), count(*), CAST(sum(doc_id) AS BIGINT) FROM inventory WHERE doc_id % 3 = 0 GROUP BY 2""",
)
def write_table(spark, sf):
    """Two runs, of which the first is written twice."""
    rows = X.inventory(spark, sf).select("doc_id", "document_id", (1 + F.col("doc_id") % 2).cast("int").alias("pass_number"))
    path = S.new_path(spark)
    for run, some in (("r1", rows.where("doc_id % 5 = 0")), ("r2", rows.where("doc_id % 3 = 0")), ("r1", rows)):
        S.write_table(some, path, run, "pass_number", order=["document_id"])
    found = S.read_run(spark, path, "r1").unionByName(S.read_run(spark, path))
    return found.groupBy("run_id", F.col("pass_number").cast("int").alias("pass_number")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("append_log", "SELECT user_id, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2")
def append_log(spark, sf):
    """Appends that overlap; each key is there once."""
    rows, path = X.table(spark, sf, "events").select("event_id", "user_id", "event_type"), S.new_path(spark)
    for some in (rows.where("event_id % 3 = 0"), rows.where("event_id % 2 = 0"), rows, rows.where("user_id < 20")):
        S.append_to_log(some, path, "event_id")
    return S.read_log(spark, path).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


TREATED = f"""{LABELLED},
tre AS (SELECT *, CASE WHEN authority_rank = 'superseded' THEN 'superseded_low_priority'
        WHEN authority_rank = 'supporting' AND version_status IN ('draft', 'working_version') THEN 'draft_retained_for_unique_reasoning'
        WHEN document_role IN {_in(rules.HIGH_VALUE_ROLES)} THEN 'high_value_roles'
        WHEN document_role IN {_in(rules.LOW_VALUE_ROLES)} AND useful THEN 'evaluation_criteria_may_be_useful'
        WHEN document_role IN {_in(rules.LOW_VALUE_ROLES)} THEN 'opportunity_boilerplate_not_high_value'
        WHEN budget OR personal THEN 'budgets_excluded_from_rag' END AS policy_applied,
    CASE WHEN budget OR personal THEN 'exclude' WHEN useful THEN 'summary_only' WHEN boilerplate THEN 'metadata_only'
        WHEN rag_priority = 'high' THEN 'full_document' WHEN rag_priority = 'medium' THEN 'summary_only'
        WHEN rag_priority = 'low' THEN 'metadata_only' ELSE 'exclude' END AS recommended_treatment FROM lin),
trx AS (SELECT *, h % 2 = 0 AS described_by_model, CASE
    WHEN policy_applied = 'superseded_low_priority' AND contains_unique_reasoning THEN '{C.EXCEPTIONS["superseded_low_priority"]}'
    WHEN policy_applied = 'draft_retained_for_unique_reasoning' AND contains_unique_reasoning THEN '{C.EXCEPTIONS["draft_retained_for_unique_reasoning"]}'
    WHEN policy_applied = 'evaluation_criteria_may_be_useful' THEN '{C.EXCEPTIONS["evaluation_criteria_may_be_useful"]}' END AS exception_reason FROM tre),
prop AS (SELECT proposal_id, min(proposal_branch) AS proposal_name, CASE WHEN sha256(proposal_id)[1:1] < '8' THEN 'model' ELSE 'deterministic' END AS synthesis_source,
    count(*) AS document_count FROM docs GROUP BY 1),
dcs AS (SELECT proposal_id, 'proposal_context.' || document_role AS field, CAST(h % 4 AS INTEGER) AS impact, 'q' || doc_id AS question_id,
    CASE WHEN h2 % 2 = 0 THEN 'proposal_fact' END AS decision_type, ['low', 'medium', 'high', 'critical'][h % 4 + 1] AS priority FROM docs WHERE h2 % 8 = 0),
ovd AS (SELECT proposal_id, 'q_' || document_id AS question_id, 'status' AS field, status AS applied_value, doc_id AS seq FROM docs WHERE h % 10 = 0)
"""


def treated(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_exceptions(C.treatments(C.lineage(documents(spark, sf)))).withColumns(
        {"described_by_model": F.col("h") % 2 == 0, "contains_unique_reasoning": F.coalesce("contains_unique_reasoning", F.lit(False))}
    )


def proposals(docs: DataFrame) -> DataFrame:
    source = F.when(F.substring(F.sha2("proposal_id", 256), 1, 1) < "8", "model").otherwise("deterministic")
    return docs.groupBy("proposal_id").agg(F.min("proposal_branch").alias("proposal_name"), F.count("*").alias("document_count")).withColumn("synthesis_source", source)


def open_decisions(docs: DataFrame) -> DataFrame:
    return docs.where("h2 % 8 = 0").select(
        "proposal_id", F.concat(F.lit("proposal_context."), "document_role").alias("field"), (F.col("h") % 4).cast("int").alias("impact"),
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question_id"), F.when(F.col("h2") % 2 == 0, "proposal_fact").alias("decision_type"),
        X.pick(("low", "medium", "high", "critical"), F.col("h") % 4).alias("priority"),
    )


def _count_sql(table: str, dimension: str, value: str, tokens: str = "0") -> str:
    return f"SELECT '{dimension}' AS dimension, CAST({value} AS VARCHAR) AS value, count(*) AS n, CAST(coalesce(sum({tokens}), 0) AS BIGINT) AS tokens FROM {table} GROUP BY 2"


@query(
    "run_counts",
    f"{TREATED}, {USAGE.removeprefix('WITH ')} "
    + " UNION ALL ".join(
        [
            _count_sql("trx", "treatment", "recommended_treatment"), _count_sql("trx", "policy", "policy_applied"),
            _count_sql("dcs", "questions_by_proposal", "proposal_id"), _count_sql("dcs", "decision_type", "coalesce(decision_type, 'unknown')"),
            _count_sql("dcs", "priority", "priority"), _count_sql("prop", "synthesis_source", "synthesis_source"),
            _count_sql("u", "stage", "'pass' || pass_number", "total_tokens"), _count_sql("u", "success", "success", "total_tokens"),
        ]
    ),
)
def run_counts(spark, sf):
    docs = treated(spark, sf)
    return P.run_counts(docs, open_decisions(docs), proposals(docs), usage(spark, sf))


def _child_sql(name: str, table: str, columns: str, order: str, where: str = "true") -> str:
    body = ", ".join(f"'{c}', {c}" for c in columns.split(", "))
    return f"""c_{name} AS (SELECT proposal_id, string_agg(CAST(json_object({body}) AS VARCHAR), '|' ORDER BY {order}) FILTER (p <= {MOST}) AS {name}, count(*) AS n_{name}
        FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY {order}) AS p FROM {table} WHERE {where}) GROUP BY 1)"""


#: Entries a list holds in the queries below, few enough that lists are cut on the given tables.
MOST = 4
ID = "document_id, doc_id"
PROVENANCE = {
    "authoritative_documents": ("trx", "document_id", ID, "authority_rank = 'authoritative'"),
    "retained_low_priority_documents": ("trx", "document_id", ID, "authority_rank <> 'authoritative' AND contains_unique_reasoning"),
    "downgraded_documents": ("trx", "document_id", ID, "authority_rank <> 'authoritative' AND NOT contains_unique_reasoning"),
    "excluded_documents": ("trx", "document_id", ID, "NOT keep"),
    "policy_exceptions": ("trx", "document_id, policy_applied, exception_reason", ID, "exception_reason IS NOT NULL"),
    "model_inferences": ("trx", "document_id, file_name_original", ID, "described_by_model"),
    "human_overrides_applied": ("ovd", "question_id, field, applied_value, seq", "seq", "true"),
    "remaining_unresolved_decisions": ("dcs", "field, impact", "field, question_id", "true"),
    "treatment_by_document": ("trx", "document_id, recommended_treatment, rag_priority", ID, "true"),
}


def _nested_sql(children: dict) -> tuple[str, str, str]:
    """CTEs, joins and columns of child lists."""
    return (
        ", ".join(_child_sql(n, *spec) for n, spec in children.items()),
        " ".join(f"LEFT JOIN c_{n} USING (proposal_id)" for n in children),
        ", ".join(f"coalesce({n}, '') AS {n}, coalesce(n_{n}, 0) AS n_{n}" for n in children),
    )


_CTES, _JOINS, _COLUMNS = _nested_sql(PROVENANCE)


@query(
    "provenance_report",
    f"""{TREATED}, {_CTES},
        pol AS (SELECT proposal_id, string_agg(policy_applied || '=' || n, ',' ORDER BY policy_applied) AS policies
            FROM (SELECT proposal_id, policy_applied, count(*) AS n FROM trx WHERE policy_applied IS NOT NULL GROUP BY ALL) GROUP BY 1)
        SELECT prop.*, {_COLUMNS}, coalesce(policies, '') AS policies FROM prop {_JOINS} LEFT JOIN pol USING (proposal_id)""",
)
def provenance_report(spark, sf):
    docs = S.stored(treated(spark, sf).drop("summary_short", "summary_detailed", "partners"))
    answered = docs.where("h % 10 = 0").select(
        "proposal_id", F.concat(F.lit("q_"), "document_id").alias("question_id"), F.lit("status").alias("field"), F.col("status").alias("applied_value"), F.col("doc_id").alias("seq")
    )
    out = P.provenance_report(proposals(docs), docs, answered, open_decisions(docs), MOST)
    shown = F.transform(F.map_entries("standing_policies_applied"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    lists = {n: F.array_join(n, "|") for n in PROVENANCE}
    return out.withColumns(lists | {"policies": F.array_join(shown, ",")}).drop("standing_policies_applied")


RETRIEVAL = {
    "document_lineage": ("trx", "document_id, document_role, version_status, authority_rank, superseded_by_document_id, contains_unique_reasoning", ID, "true"),
    "key_documents": ("keys", "document_id, document_role, key_rank", "key_rank", "true"),
    "knowledge_base_treatment": ("trx", "document_id, recommended_treatment, rag_priority, policy_applied", ID, "true"),
    "evidence": ("evi", "source, document_id, claim, confidence", "source, claim, document_id", "true"),
    "unresolved_decisions": ("dcs", "field, impact", "field, question_id", "true"),
    "restricted_document_ids": ("trx", "document_id", ID, "personal"),
}
_CTES, _JOINS, _COLUMNS = _nested_sql(RETRIEVAL)


@query(
    "full_retrieval_record",
    f"""{TREATED}, r AS (SELECT *, {_ORDER} AS o, row_number() OVER (PARTITION BY proposal_id, document_role ORDER BY authority_rank <> 'authoritative', document_id, doc_id) AS n FROM trx),
        b AS (SELECT *, CASE WHEN o < {len(KEY_ROLES)} AND n = 1 THEN 0 WHEN rag_priority = 'high' THEN 1 END AS band FROM r),
        keys AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY proposal_id ORDER BY band, CASE WHEN band = 0 THEN o END NULLS FIRST, document_id) AS INTEGER) AS key_rank
            FROM b WHERE band IS NOT NULL) WHERE key_rank <= 10),
        evi AS (SELECT proposal_id, 'document' AS source, document_id, canonical_proposal_name AS claim, name_confidence AS confidence FROM docs WHERE h % 16 = 1),
        {_CTES}, s AS (SELECT proposal_id, count(*) AS n_documents, count(*) FILTER (personal) AS n_manual_review,
            {", ".join(f"count(*) FILTER (rag_priority = '{p}') AS n_{p}" for p in ("high", "medium", "low", "exclude"))},
            concat_ws(',', CASE WHEN bool_or(budget) THEN 'budget_or_rates' END, CASE WHEN bool_or(personal) THEN 'personal_info' END) AS labels_present FROM trx GROUP BY 1)
        SELECT prop.*, {_COLUMNS}, s.* EXCLUDE (proposal_id) FROM prop {_JOINS} JOIN s USING (proposal_id)""",
)
def full_retrieval_record(spark, sf):
    docs = S.stored(treated(spark, sf).drop("summary_short", "summary_detailed", "partners"))
    evidence = docs.where("h % 16 = 1").select(
        "proposal_id", F.lit("document").alias("source"), "document_id", F.col("canonical_proposal_name").alias("claim"), F.col("name_confidence").alias("confidence")
    )
    out = P.full_retrieval_record(proposals(docs), docs, C.key_documents(docs, KEY_ROLES), evidence, open_decisions(docs), MOST)
    return out.withColumns({n: F.array_join(n, "|") for n in RETRIEVAL} | {"labels_present": F.array_join("labels_present", ",")})


# Names of the standing policies.
POLICIES = {
    "submitted_final_authoritative": "A submitted or final version outranks drafts.",
    "draft_retained_for_unique_reasoning": "A draft that reasons on its own is kept, at low priority.",
    "superseded_low_priority": "What was replaced has low priority unless it reasons on its own.",
    "high_value_roles": "Technical texts, reviews, awards and reports are worth most.",
    "opportunity_boilerplate_not_high_value": "Long formal texts of an opportunity aren't worth more for that.",
    "evaluation_criteria_may_be_useful": "Criteria of evaluation may be worth more than instructions.",
    "budgets_excluded_from_rag": "Budgets, rates and personal data stay out of general retrieval.",
    "tracker_high_authority": "The tracker outranks documents on dates, status and outcome.",
    "exceptions_must_be_documented": "An exception from a policy says why.",
}


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICIES.items()), "id string, statement string")


_STANDING = "[" + ", ".join(f"json_object('id', '{k}', 'statement', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in sorted(POLICIES.items())) + "]"


@query(
    "request_payloads",
    f"""{TREATED}, {X.TRACKER_SQL},
        tk AS (SELECT DISTINCT proposal_id, row_id, proposal_name, tracker.status FROM (SELECT DISTINCT proposal_id, g FROM inventory WHERE proposal_branch IS NOT NULL) JOIN tracker USING (g)),
        td AS (SELECT proposal_id, to_json(list(json_object('document_id', document_id, 'document_role', document_role, 'summary_short', summary_short) ORDER BY document_id, doc_id)) AS d, count(*) AS n FROM docs GROUP BY 1),
        tt AS (SELECT proposal_id, to_json(list(json_object('row_id', row_id, 'proposal_name', proposal_name, 'status', status) ORDER BY row_id)) AS t
            FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY row_id) AS p FROM tk) WHERE p <= 20 GROUP BY 1),
        al AS (SELECT prop.proposal_id, n, proposal_name, d, coalesce(t, '[]'::JSON) AS t FROM prop JOIN td USING (proposal_id) LEFT JOIN tt USING (proposal_id))
        SELECT proposal_id, n AS n_documents, json_array_length(t) AS n_rows, CAST(json_extract_string(CAST(to_json({_STANDING}) AS JSON), '$[0].id') AS VARCHAR) AS policy,
            sha256(array_to_string(list_transform(from_json(d, '["JSON"]'), lambda x: concat_ws(',', json_extract_string(x, '$.document_id'), json_extract_string(x, '$.document_role'),
                sha256(json_extract_string(x, '$.summary_short')))), '|')) AS documents_sha256 FROM al""",
)
def request_payloads(spark, sf):
    """Requests read back: how many tracker rows and documents they hold, and a digest of the latter with their whole texts."""
    docs = documents(spark, sf)
    groups = X.inventory(spark, sf).where("proposal_branch is not null").select("proposal_id", "g").distinct()
    near = X.tracker(spark, sf).select("g", "row_id", "proposal_name", "status").join(groups.hint("merge"), "g").drop("g").distinct()
    out = P.request_payloads(proposals(docs), docs, ["document_id", "document_role", "summary_short"], ("document_id", "doc_id"), near, policy_table(spark))
    form = "struct<documents:array<struct<document_id:string,document_role:string,summary_short:string>>,tracker_candidates:array<struct<row_id:string>>,standing_policies:array<struct<id:string>>>"
    read = out.select("proposal_id", "n_documents", F.from_json("payload", form).alias("p"))
    said = F.transform("p.documents", lambda d: F.concat_ws(",", d["document_id"], d["document_role"], F.sha2(d["summary_short"], 256)))
    return read.select(
        "proposal_id", "n_documents", F.size("p.tracker_candidates").cast("long").alias("n_rows"), F.col("p.standing_policies")[0]["id"].alias("policy"),
        F.sha2(F.array_join(said, "|"), 256).alias("documents_sha256"),
    )


UNCERTAIN = """
ufd AS (SELECT proposal_id AS group_id, 'proposal_context.' || CASE WHEN h % 2 = 0 THEN ' Award_Status' ELSE 'status' END AS field, ['proposal', 'document_family', 'document'][h2 % 3 + 1] AS scope,
    award_status AS guess, h / 256.0::DOUBLE AS confidence, CAST(h2 % 4 AS INTEGER) AS impact, [document_role, version_status] AS evidence,
    'reason ' || h2 % 3 AS reason, document_id, doc_id AS ord FROM docs WHERE h % 4 < 2)
"""


def document_uncertainties(docs: DataFrame) -> DataFrame:
    h, h2 = F.col("h"), F.col("h2")
    return docs.where("h % 4 < 2").select(
        F.col("proposal_id").alias("group_id"), F.concat(F.lit("proposal_context."), F.when(h % 2 == 0, " Award_Status").otherwise("status")).alias("field"),
        X.pick(("proposal", "document_family", "document"), h2 % 3).alias("scope"), F.col("award_status").alias("guess"), (h / 256.0).alias("confidence"),
        (h2 % 4).cast("int").alias("impact"), F.array("document_role", "version_status").alias("evidence"),
        F.concat(F.lit("reason "), (h2 % 3).cast("string")).alias("reason"), "document_id", F.col("doc_id").alias("ord"),
    )


@query(
    "consolidate_all",
    f"""{LABELLED}, {MATCHED}, {UNCERTAIN},
        cv AS (SELECT proposal_id, string_agg(DISTINCT award_status, ', ' ORDER BY award_status) AS vs FROM docs
            WHERE award_status NOT IN ('', 'unknown') AND proposal_id NOT IN (SELECT proposal_id FROM mt WHERE match_status = 'matched') GROUP BY 1 HAVING count(DISTINCT award_status) > 1),
        cf AS (SELECT proposal_id AS group_id, 'canonical_identity.award_status' AS field, NULL AS guess, 0.0::DOUBLE AS confidence, 2 AS impact,
            ['Values of award_status differ and the tracker has no row for it: ' || vs] AS evidence, 'No tracker row decides between the values that documents state.' AS reason,
            document_id, 1000000000000 AS ord FROM docs JOIN cv USING (proposal_id) WHERE award_status NOT IN ('', 'unknown')),
        al AS (SELECT *, lower(trim(string_split(field, '.')[-1])) AS field_key FROM (SELECT * EXCLUDE (scope) FROM ufd WHERE scope <> 'document' UNION ALL BY NAME SELECT * FROM cf)),
        mn AS (SELECT group_id, field_key, arg_min(field, ord) AS field, max(confidence) AS confidence, max(impact) AS impact, count(*) AS sources,
            count(DISTINCT document_id) AS n_affected FROM al GROUP BY 1, 2),
        gs AS (SELECT group_id, field_key, guess FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_key ORDER BY confidence DESC, ord) AS r FROM al) WHERE r = 1),
        ev AS (SELECT group_id, field_key, ord, unnest(range(1, len(evidence) + 1)) AS p, unnest(evidence) AS item FROM al),
        e2 AS (SELECT group_id, field_key, item, min(ord * 10 + p) AS o FROM ev WHERE item IS NOT NULL GROUP BY ALL),
        e3 AS (SELECT group_id, field_key, string_agg(item, '; ' ORDER BY o) AS evidence FROM e2 GROUP BY 1, 2),
        r2 AS (SELECT group_id, field_key, reason, min(ord) AS o FROM al GROUP BY ALL),
        r3 AS (SELECT group_id, field_key, string_agg(reason, ' ' ORDER BY o) AS reasons FROM r2 GROUP BY 1, 2),
        a3 AS (SELECT group_id, field_key, string_agg(DISTINCT document_id, '|' ORDER BY document_id) AS affected FROM al GROUP BY 1, 2)
        SELECT group_id, field_key, field, guess, confidence, impact, sources, n_affected, evidence, reasons, affected,
            'q_' || left(sha256(group_id || '|proposal|proposal_fact|' || field_key), 12) AS question_id
        FROM mn JOIN gs USING (group_id, field_key) LEFT JOIN e3 USING (group_id, field_key) LEFT JOIN r3 USING (group_id, field_key) LEFT JOIN a3 USING (group_id, field_key)""",
)
def consolidate_all(spark, sf):
    docs = S.stored(documents(spark, sf).drop("summary_short", "summary_detailed", "partners"))
    groups = docs.select("proposal_id", "proposal_branch").distinct()
    found = D.conflicts(docs, "award_status", M.match_tracker(groups, X.tracker(spark, sf)))
    out = D.consolidate_all(document_uncertainties(docs), found)
    return out.withColumn("affected", F.array_join("affected_document_ids", "|")).drop("affected_document_ids")


@query(
    "match_tracker_named",
    f"""{LABELLED}, {X.TRACKER_SQL},
        nm AS (SELECT proposal_id, min(proposal_branch) AS branch, min(canonical_proposal_name) FILTER (canonical_proposal_name <> 'unknown') AS name FROM docs GROUP BY 1),
        hh AS (SELECT proposal_id, {TOKENS.format("concat_ws(' ', branch, name)")} AS ht FROM nm),
        rr AS (SELECT row_id, {TOKENS.format("proposal_name")} AS rt FROM tracker),
        sc AS (SELECT proposal_id, row_id, len(list_intersect(ht, rt)) / (len(ht) + len(rt) - len(list_intersect(ht, rt))) AS score FROM hh, rr),
        bs AS (SELECT proposal_id, max(score) AS best FROM sc GROUP BY 1),
        kk AS (SELECT sc.proposal_id, count(*) AS k, min(row_id) AS top, list(row_id ORDER BY row_id) AS ids FROM sc JOIN bs USING (proposal_id) WHERE best >= 0.35 AND best - score < 0.05 GROUP BY 1)
        SELECT proposal_id, CASE WHEN k IS NULL THEN 'unmatched' WHEN k > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status, coalesce(best, 0.0) AS confidence,
            coalesce(k, 0) AS n_candidates, CASE WHEN k = 1 THEN top END AS row_id, coalesce(array_to_string(ids[1:20], '|'), '') AS candidates
        FROM hh LEFT JOIN bs USING (proposal_id) LEFT JOIN kk USING (proposal_id)""",
)
def match_tracker_named(spark, sf):
    known = F.when(F.col("canonical_proposal_name") != "unknown", F.col("canonical_proposal_name"))
    groups = documents(spark, sf).groupBy("proposal_id").agg(F.min("proposal_branch").alias("proposal_branch"), F.min(known).alias("canonical_proposal_name"))
    out = M.match_tracker(groups, X.tracker(spark, sf), common=50)
    return out.withColumn("candidates", F.array_join("candidate_row_ids", "|")).drop("candidate_row_ids")


#: Values of a record with what the second opinion says of each: a value by a hash digit, or the record's own.
SECOND = {
    "document_category": ("unknown", "technical_data", None, None), "document_role": (None, "budget", "unknown", "award_notice"),
    "origin_type": (None, "generated_response", None, "unknown"), "version_status": ("final", None, None, "draft"),
    "canonical_proposal_name": (None, None, "Renamed Study", "unknown"), "agency": ("NSF", None, "unknown", None),
    "program": (None, "SBIR", None, None), "status": (None, "awarded", "unknown", None), "award_status": ("selected", None, None, "unknown"),
    "include_in_clean_set": ("true", None, "false", None), "include_in_future_rag": (None, "false", None, "true"), "rag_priority": ("high", None, None, "low"),
}
BOOLEANS = ("include_in_clean_set", "include_in_future_rag")


def _digit(i: int) -> str:
    return f"CAST('0x' || sha256[{i + 5}:{i + 5}] AS INTEGER)"


def _second_sql(i: int, name: str) -> str:
    own = f"CAST({'keep' if name in BOOLEANS else name} AS VARCHAR)"
    cases = " ".join(f"WHEN {k} THEN {own if v is None else repr(v)}" for k, v in enumerate(SECOND[name]))
    return f"{own} AS a{i}, {_digit(i)} / 16 AS ac{i}, CASE {_digit(i)} % 4 {cases} END AS b{i}, {_digit(i + 12)} / 16 AS bc{i}"


def _unknown_sql(c: str) -> str:
    return f"(lower(trim(coalesce({c}, ''))) IN ('', 'unknown'))"


def _taken_sql(i: int) -> str:
    a, b, c1, c2 = f"a{i}", f"b{i}", f"ac{i}", f"bc{i}"
    return f"""coalesce(given AND a{i} IS DISTINCT FROM b{i} AND CASE WHEN {_unknown_sql(b)} THEN false WHEN {_unknown_sql(a)} THEN {c2} >= 0.5
        WHEN {c1} >= 0.5 THEN noted AND {c2} > {c1} ELSE {c2} > {c1} END, false) AS t{i}, given AND a{i} IS NOT DISTINCT FROM b{i} AND {c2} > {c1} AS s{i}"""


_N = range(len(SECOND))
PASSES = f"""{LABELLED},
q0 AS (SELECT doc_id, doc_id % 4 <> 3 AS given, doc_id % 3 <> 1 AS noted, {", ".join(_second_sql(i, n) for i, n in enumerate(SECOND))},
    CASE WHEN h % 3 = 0 THEN [] ELSE [document_role, 'u' || h % 3] END AS u1, CASE WHEN h % 2 = 0 THEN [] ELSE [document_role, 'u1'] END AS u2,
    ['first', 'n' || h % 2] AS n1, CASE WHEN doc_id % 3 <> 1 THEN ['n' || h2 % 2, 'second'] ELSE [] END AS n2 FROM docs),
q1 AS (SELECT *, {", ".join(map(_taken_sql, _N))}, given AND u1 <> u2 AS ur FROM q0)
"""


def passes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf)
    digit = lambda i: F.conv(F.substring("sha256", i + 5, 1), 16, 10).cast("int")
    listed = lambda *c: F.array(*c).cast("array<string>")
    mine, theirs = {}, {}
    for i, (name, given) in enumerate(SECOND.items()):
        own = F.col(name).cast("string")
        mine |= {name: own, f"{name}_confidence": digit(i) / 16}
        case = own
        for k, v in enumerate(given):
            case = case if v is None else F.when(digit(i) % 4 == k, v).otherwise(case)
        theirs |= {name: case, f"{name}_confidence": digit(i + 12) / 16}
    h, h2 = F.col("h"), F.col("h2")
    u = lambda n, m: F.when(h % n == 0, listed()).otherwise(listed("document_role", m))
    mine |= {
        "uncertainties": u(3, F.concat(F.lit("u"), (h % 3).cast("string"))), "processing_notes": listed(F.lit("first"), F.concat(F.lit("n"), (h % 2).cast("string"))),
    }
    theirs |= {
        "uncertainties": u(2, F.lit("u1")),
        "processing_notes": F.when(F.col("doc_id") % 3 != 1, listed(F.concat(F.lit("n"), (h2 % 2).cast("string")), F.lit("second"))).otherwise(listed()),
    }
    pick = lambda of, rows: rows.select("doc_id", *(c.alias(n) for n, c in of.items()))
    return pick(mine, docs), pick(theirs, docs.where("doc_id % 4 <> 3"))


@query(
    "merge_records",
    f"""{PASSES} SELECT doc_id, {", ".join(f"CASE WHEN t{i} THEN b{i} ELSE a{i} END AS {n}, CASE WHEN t{i} OR s{i} THEN bc{i} ELSE ac{i} END AS {n}_confidence" for i, n in enumerate(SECOND))},
        array_to_string(CASE WHEN given THEN u2 ELSE u1 END, '|') AS uncertainties,
        array_to_string(CASE WHEN given THEN list_append(list_concat(n1, list_filter(n2, lambda x: NOT list_contains(n1, x))), '{Z.NOTE}') ELSE n1 END, '|') AS notes,
        CASE WHEN given THEN 'pass1:' || a1 || '|pass2_candidate:' || b1 || '|pass2_merged:' || CASE WHEN t1 THEN b1 ELSE a1 END ELSE '' END AS snapshots,
        CAST({" + ".join(f"CAST(t{i} AS INTEGER) + CAST(s{i} AS INTEGER)" for i in _N)} + CAST(ur AS INTEGER) AS INTEGER) AS n_changes FROM q1""",
)
def merge_records(spark, sf):
    out = Z.merge_records(*passes(spark, sf), "doc_id", threshold=0.5)
    shots = F.transform("history", lambda x: F.concat(x["stage"], F.lit(":"), F.try_variant_get(x["record"], "$.document_role", "string")))
    return out.select(
        "doc_id", *(c for n in SECOND for c in (n, f"{n}_confidence")), F.array_join("uncertainties", "|").alias("uncertainties"),
        F.array_join("processing_notes", "|").alias("notes"), F.array_join(shots, "|").alias("snapshots"), F.size("changes").alias("n_changes"),
    )


@query(
    "merge_records_log",
    f"""{PASSES} {" UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS field_path, a{i} AS old_value, b{i} AS new_value, ac{i} AS old_confidence, bc{i} AS new_confidence, '{Z.ADOPTED}' AS reason FROM q1 WHERE t{i}"
        f" UNION ALL SELECT doc_id, '{n}_confidence', CAST(ac{i} AS VARCHAR), CAST(bc{i} AS VARCHAR), ac{i}, bc{i}, '{Z.RAISED}' FROM q1 WHERE s{i}"
        for i, n in enumerate(SECOND))}
        UNION ALL SELECT doc_id, 'uncertainties', CAST(json_object('u', u1) AS VARCHAR), CAST(json_object('u', u2) AS VARCHAR), 0.0, 0.0, '{Z.REPLACED}' FROM q1 WHERE ur""",
)
def merge_records_log(spark, sf):
    return Z.change_log(Z.merge_records(*passes(spark, sf), "doc_id", threshold=0.5), "doc_id")


SHEETS = {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_nationkey"}


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of a nation's business as the sheets of its workbook; some cells are blank."""
    blank = {"customer": ("c_mktsegment", F.col("c_custkey") % 3 == 0), "supplier": ("s_name", F.col("s_suppkey") % 2 == 0), "nation": ("n_name", F.lit(False))}
    tables = {}
    for name, key in SHEETS.items():
        column, empty = blank[name]
        tables[name] = (X.table(spark, sf, name).withColumn(column, F.when(empty, F.lit("  ")).otherwise(F.col(column))), key)
    return O.all_cells(tables)


def _columns(name: str) -> list[str]:
    return {
        "customer": ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_acctbal"], "nation": ["n_name", "n_regionkey"],
    }[name]


_BLANK = {"c_mktsegment": "c_custkey % 3 = 0", "s_name": "s_suppkey % 2 = 0"}


def _cell(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {_BLANK[column]} THEN '  ' ELSE {text} END" if column in _BLANK else text


CELLS = "cel AS (" + " UNION ALL ".join(
    f"SELECT CAST({key} AS VARCHAR) AS file_key, '{name}' AS sheet, '{c}' AS \"column\", {_cell(c)} AS value FROM {name}" for name, key in SHEETS.items() for c in _columns(name)
) + ")"


@query(
    "column_profiles",
    f"""WITH {CELLS} SELECT file_key, sheet, "column", count(*) AS n_cells, count(*) FILTER (trim(coalesce(value, '')) <> '') AS n_filled,
        count(TRY_CAST(trim(value) AS DOUBLE)) AS n_numbers, min(value) FILTER (trim(value) <> '') AS least, max(value) FILTER (trim(value) <> '') AS greatest,
        max(length(value)) FILTER (trim(value) <> '') AS longest FROM cel GROUP BY ALL""",
)
def column_profiles(spark, sf):
    return O.column_profiles(sheets(spark, sf)).withColumn("longest", F.col("longest").cast("long"))


@query(
    "strategy_by_profile",
    f"""{INV}, {CELLS}, st AS (SELECT file_key, count(DISTINCT sheet) AS sheets, count(*) FILTER (trim(coalesce(value, '')) <> '') AS cells FROM cel GROUP BY 1)
        SELECT doc_id, coalesce(sheets, -1) AS sheets, coalesce(cells, -1) AS cells, CASE WHEN CASE WHEN extension IN ('.xlsx', '.xls')
            THEN size_bytes / 1048576 <= 0.01 AND coalesce(sheets, -1) BETWEEN 0 AND 3 AND coalesce(cells, -1) BETWEEN 0 AND 40
            ELSE extension IN ('.pdf', '.docx', '.doc', '.csv', '.txt', '.md') AND size_bytes / 1048576 <= 0.02 END
        THEN 'direct_bedrock' ELSE 'local_extract_then_bedrock' END AS effective_strategy
        FROM inventory LEFT JOIN st ON file_key = CAST(doc_id % 30 AS VARCHAR)""",
)
def strategy_by_profile(spark, sf):
    stats = O.workbook_stats(sheets(spark, sf))
    inv = O.with_workbook_stats(X.inventory(spark, sf).withColumn("workbook", F.col("doc_id") % 30), stats, "workbook")
    return I.choose_strategy(inv, max_direct_mb=0.02, sheet_mb=0.01, max_cells=40).select("doc_id", "sheets", "cells", "effective_strategy")
