"""Queries of the scorer seam, with a scripted scorer in a model's place: what it does follows from a text's hash."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F

from foliant import rules
from foliant.operators import inventory as I
from foliant.operators import responses as R
from foliant.operators import scoring as S
from foliant.plans.registry import CLASSED, INV, query
from foliant.sources import fixtures as X

#: Characters from which the scripted scorer refuses a direct upload.
LARGE = 2000


def scripted(requests: pd.DataFrame) -> pd.DataFrame:
    """Fails on some texts, refuses large uploads, and answers others with no object, with a category that there isn't, or
    well. Its hash decides: of the whole prompt."""
    rows = []
    for pass_number, strategy, prompt in zip(requests["pass_number"], requests["strategy"], requests["prompt"], strict=True):
        h = hashlib.sha256(prompt.encode()).hexdigest()
        if pass_number == 1 and strategy == "direct_bedrock" and len(prompt) > LARGE:
            raise ValueError("over the maximum document size")
        if h[0] == ("0" if pass_number == 1 else "f"):
            raise RuntimeError(f"no answer {h[:8]}")
        category = rules.CATEGORIES[int(h[2], 16) % len(rules.CATEGORIES)]
        good = json.dumps({"document_identity": {"document_category": category}, "confidence": {"document_category": int(h[3], 16) / 16}})
        if pass_number == 1:
            raw = f"no object {h}" if h[1] in "01" else good.replace(category, "nonsense") if h[1] == "2" else good
        else:
            raw = good if h[0] < "8" else f"still none {h}"
        rows.append((raw, len(prompt), len(raw)))
    return pd.DataFrame(rows, columns=list(S.ANSWER))


_RAW = """'{"document_identity": {"document_category": "' || CATEGORY || '"}, "confidence": {"document_category": ' ||
    CAST(CAST(('0x' || H[4:4]) AS INTEGER) / 16 AS VARCHAR) || '}}'"""
_LIST = "[" + ", ".join(f"'{c}'" for c in rules.CATEGORIES) + "]"


def _category(h: str) -> str:
    return f"{_LIST}[CAST('0x' || {h}[3:3] AS INTEGER) % {len(rules.CATEGORIES)} + 1]"


#: What the scripted scorer makes of the eligible documents: first tries, their second ones, repairs.
SCORED = f"""{INV}, {CLASSED},
kept AS (SELECT document_id, arg_max(doc_id, scan_ord) AS doc_id FROM inventory GROUP BY 1),
f0 AS (SELECT c.document_id, summary_short AS text, summary_detailed AS extracted,
    CASE WHEN extension IN ('.xlsx', '.xls') THEN 'local_extract_then_bedrock' ELSE 'direct_bedrock' END AS strategy
    FROM classed c JOIN kept USING (doc_id) WHERE eligible),
f1 AS (SELECT *, strategy = 'direct_bedrock' AND length(text) > {LARGE} AS refused,
    coalesce(nullif(regexp_replace(extracted, '^\\s+|\\s+$', '', 'g'), ''), '(no text)') AS sent FROM f0),
f2 AS (SELECT *, CASE WHEN refused THEN 'local_extract_then_bedrock' ELSE strategy END AS last_strategy,
    CASE WHEN refused OR strategy <> 'direct_bedrock' THEN sent ELSE text END AS prompt FROM f1),
f3 AS (SELECT *, sha256(prompt) AS h FROM f2),
f4 AS (SELECT *, h[1:1] = '0' AS failed, CASE WHEN h[2:2] IN ('0', '1') THEN 'no object ' || h
    WHEN h[2:2] = '2' THEN {_RAW.replace("CATEGORY", "'nonsense'").replace("H[", "h[")}
    ELSE {_RAW.replace("CATEGORY", _category("h")).replace("H[", "h[")} END AS raw FROM f3),
f5 AS (SELECT *, NOT failed AND h[2:2] IN ('0', '1', '2') AS bad,
    CASE WHEN h[2:2] = '2' THEN 'document_category' ELSE 'object,document_category,confidence' END AS why FROM f4),
f6 AS (SELECT *, CASE WHEN bad THEN why || chr(10) || raw END AS prompt2, sha256(why || chr(10) || raw) AS k FROM f5),
f7 AS (SELECT *, bad AND k[1:1] = 'f' AS failed2, bad AND k[1:1] < '8' AS mended,
    CASE WHEN k[1:1] < '8' THEN {_RAW.replace("CATEGORY", _category("k")).replace("H[", "k[")} ELSE 'still none ' || k END AS raw2 FROM f6)
"""


def scored(spark, sf):
    chosen = I.classify_files(I.dedup_content(X.inventory(spark, sf))).where("eligible_for_processing")
    documents = chosen.select("document_id", "processing_strategy", F.col("summary_short").alias("text"), F.col("summary_detailed").alias("extracted"))
    return S.score_documents(documents, scripted)


@query(
    "score_documents",
    f"""{SCORED} SELECT document_id, CAST(CASE WHEN bad THEN 2 ELSE 1 END AS INTEGER) AS pass_number, last_strategy AS strategy,
        CASE WHEN bad THEN {_category("k")} ELSE {_category("h")} END AS document_category,
        CAST('0x' || (CASE WHEN bad THEN k ELSE h END)[4:4] AS INTEGER) / 16 AS confidence
        FROM f7 WHERE NOT failed AND (NOT bad OR mended)""",
)
def score_documents(spark, sf):
    return scored(spark, sf).responses.select("document_id", "pass_number", "strategy", "document_category", "confidence")


@query(
    "score_usage",
    f"""{SCORED}, u AS (SELECT document_id, 1 AS attempt, strategy, NOT refused AND NOT failed AS success, length(text) AS i, length(raw) AS o,
            CASE WHEN refused THEN 'ValueError' WHEN failed THEN 'RuntimeError' END AS error_type FROM f7 WHERE strategy = 'direct_bedrock'
        UNION ALL SELECT document_id, CASE WHEN refused THEN 2 ELSE 1 END, last_strategy, NOT failed, length(prompt), length(raw),
            CASE WHEN failed THEN 'RuntimeError' END FROM f7 WHERE refused OR strategy <> 'direct_bedrock'
        UNION ALL SELECT document_id, 3, last_strategy, NOT failed2, length(prompt2), length(raw2), CASE WHEN failed2 THEN 'RuntimeError' END FROM f7 WHERE bad)
        SELECT document_id, CAST(attempt AS INTEGER) AS attempt, strategy, success, CASE WHEN success THEN i END AS input_tokens,
            CASE WHEN success THEN o END AS output_tokens, CASE WHEN success THEN i + o ELSE 0 END AS total_tokens, error_type FROM u""",
)
def score_usage(spark, sf):
    return scored(spark, sf).usage.select(
        "document_id", "attempt", "strategy", "success", "input_tokens", "output_tokens", "total_tokens", "error_type"
    )


@query(
    "score_failures",
    f"""{SCORED} SELECT document_id, CASE WHEN failed THEN 'bedrock_call_failed' WHEN failed2 THEN 'repair_bedrock_failed' ELSE 'validation_failed' END AS error_type,
        CASE WHEN failed THEN 'no answer ' || h[1:8] WHEN failed2 THEN 'no answer ' || k[1:8] ELSE 'object,document_category,confidence' END AS details,
        CASE WHEN NOT failed AND NOT failed2 THEN left(raw2, 500) END AS preview,
        CASE WHEN refused THEN 'over the maximum document size' END AS direct_upload_error
        FROM f7 WHERE failed OR (bad AND NOT mended)""",
)
def score_failures(spark, sf):
    return scored(spark, sf).failures


#: Spellings that the responses below give, by path; the last of each isn't a known one.
SPELLED = {
    "document_identity.document_category": ("budget", "Technical_Data", "technical_data", "poem"), "document_identity.document_role": ("Support Letter", "budget", "foa", "song"),
    "document_identity.origin_type": ("generated", "award", "federal agency", "mars"), "document_identity.version_status": ("final", "draft", "template", "torn"),
    "opportunity_treatment.recommended_rag_treatment": ("full text", "summary", "manual_review", "burn"), "inclusion.rag_priority": ("high", "medium", "low", "odd"),
    "proposal_context.status": ("Pre-Submission", "in_progress", "awarded", "lost"), "proposal_context.program": ("SBIR Phase I", "sttr-2", "BAA", "lottery"),
}
#: What they stand for.
MEANT = {
    "document_identity.document_category": ("budget_financial", "Technical_Data", "technical_data", "poem"), "document_identity.document_role": ("letter_of_support", "budget", "foa", "song"),
    "document_identity.origin_type": ("generated_response", "award", "source_opportunity", "mars"), "document_identity.version_status": ("final", "draft", "template", "torn"),
    "opportunity_treatment.recommended_rag_treatment": ("full_document", "summary_only", "manual_review", "burn"), "inclusion.rag_priority": ("high", "medium", "low", "odd"),
    "proposal_context.status": ("drafted", "active", "awarded", "lost"), "proposal_context.program": ("SBIR", "STTR", "BAA", "lottery"),
}
CONFIDENCES = ("0.5", "1", "1.5", '"much"')


def answers_of(spark, sf):
    """Responses of a model in many spellings, by the digits of the hash of each whole text; the text itself is the title of some."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    digit = lambda i: F.conv(F.substring(h, i, 1), 16, 10).cast("int")
    groups: dict[str, list] = {}
    for i, (path, given) in enumerate(SPELLED.items()):
        head, field = path.split(".")
        groups.setdefault(head, []).append(F.when(digit(i + 1) < 14, X.pick(given, digit(i + 1) % 4)).alias(field))
    title = F.when(digit(20) < 8, F.coalesce("text", F.lit(""))).when(digit(20) < 10, " ")
    groups["document_identity"].append(title.alias("canonical_document_title"))
    sure = [F.when(digit(i + 10) < 12, X.pick(CONFIDENCES, digit(i + 10) % 4)).alias(f) for i, f in enumerate(R.SURE_OF)]
    body = F.to_json(F.struct(*(F.struct(*fields).alias(head) for head, fields in groups.items())))
    listed = F.concat_ws(", ", *(F.concat(F.lit(f'"{f}": '), c) for f, c in zip(R.SURE_OF, sure, strict=True)))
    whole = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(', "confidence": {'), listed, F.lit("}}"))
    raw = F.when(digit(21) == 0, F.coalesce("text", F.lit(""))).when(digit(21) == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    return R.canonical_fields(R.parse_strict(X.table(spark, sf, "documents").select("doc_id", raw.alias("raw_text"))))


def _d(i: int) -> str:
    return f"CAST('0x' || h[{i}:{i}] AS INTEGER)"


_VALUE = {p: f"CASE WHEN fine AND {_d(i + 1)} < 14 THEN {X._list(v)}[{_d(i + 1)} % 4 + 1] END" for i, (p, v) in enumerate(MEANT.items())}
ANSWERED = f"""WITH a0 AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents), a1 AS (SELECT *, {_d(21)} <> 0 AS fine FROM a0)"""
_NEEDED = ("document_identity.document_category", "document_identity.document_role")


def _broken(path: str) -> str:
    allowed = ", ".join(f"'{v}'" for v in R.ENUMS[path])
    wrong = f"coalesce({_VALUE[path]} IN ({allowed}), {'false' if path in _NEEDED else 'true'})"
    return f"CASE WHEN NOT {wrong} THEN '{path}' END"


def _unsure(i: int, field: str) -> str:
    there, good = f"(fine AND {_d(i + 10)} < 12)", f"(fine AND {_d(i + 10)} < 12 AND {_d(i + 10)} % 4 < 2)"
    return f"CASE WHEN {f'NOT {good}' if field == 'document_category' else f'{there} AND NOT {good}'} THEN 'confidence.{field}' END"


@query(
    "canonical_fields",
    f"""{ANSWERED} SELECT doc_id, {", ".join(f"{c} AS {p.split('.')[1]}" for p, c in _VALUE.items())}, {", ".join(
        f"CASE WHEN fine AND {_d(i + 10)} < 12 AND {_d(i + 10)} % 4 < 3 THEN [0.5, 1.0, 1.5][{_d(i + 10)} % 4 + 1]::DOUBLE END AS {f}_confidence" for i, f in enumerate(R.SURE_OF))} FROM a1""",
)
def canonical_fields(spark, sf):
    out = answers_of(spark, sf)
    return out.select(
        "doc_id", *(F.try_element_at("value", F.lit(p)).alias(p.split(".")[1]) for p in SPELLED), *(F.try_element_at("sure", F.lit(f)).alias(f"{f}_confidence") for f in R.SURE_OF)
    )


@query(
    "record_violations",
    f"""{ANSWERED} SELECT doc_id, concat_ws(',', CASE WHEN NOT fine THEN 'object' END, {", ".join(_broken(p) for p in R.ENUMS)}, {", ".join(_unsure(i, f) for i, f in enumerate(R.SURE_OF))},
        CASE WHEN fine AND (({_d(20)} < 8 AND (trim(t, ' ') = '' OR length(trim(t, ' ')) > {R.LONGEST_TITLE})) OR {_d(20)} IN (8, 9)) THEN 'title' END) AS broken FROM a1""",
)
def record_violations(spark, sf):
    return R.with_violations(answers_of(spark, sf), R.record_checks()).select("doc_id", F.array_join("violations", ",").alias("broken"))
