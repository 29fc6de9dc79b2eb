"""What a run and a group came to: counts by many dimensions, provenance of a group, and its retrieval record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Entries of a list inside a record; a longer one is cut there, its length is told, and all of it is in child_rows.
MOST_LISTED = 1000


def counts_by(rows: DataFrame, dimensions: Mapping[str, Column], tokens: Column | None = None) -> DataFrame:
    """dimension, value, n, tokens: independent counts by each dimension, in one scan with a grouping set for each. A value
    may be null; grouping ids tell it from a dimension that isn't grouped by."""
    names, every = list(dimensions), (1 << len(dimensions)) - 1
    facts = rows.select(*(c.alias(d) for d, c in dimensions.items()), (F.lit(0) if tokens is None else tokens).cast("long").alias("_tokens"))
    grouped = facts.groupingSets([[d] for d in names], *names).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n"), F.coalesce(F.sum("_tokens"), F.lit(0)).alias("tokens")
    )
    dimension = value = F.lit(None).cast("string")
    for i, d in enumerate(names):
        mine = F.col("_set") == every ^ (1 << (len(names) - 1 - i))
        dimension, value = F.when(mine, d).otherwise(dimension), F.when(mine, F.col(d).cast("string")).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n", "tokens")


def run_counts(treated: DataFrame, questions: DataFrame, proposals: DataFrame, usage: DataFrame) -> DataFrame:
    """A run's counts: documents by treatment and policy, questions by proposal, decision type and priority, groups by the
    source of their synthesis, calls and tokens by stage and outcome. Each table is read once."""
    stage = F.concat(F.lit("pass"), F.col("pass_number").cast("string"))
    parts = (
        counts_by(treated, {"treatment": F.col("recommended_treatment"), "policy": F.col("policy_applied")}),
        counts_by(questions, {"questions_by_proposal": F.col("proposal_id"), "decision_type": F.coalesce("decision_type", F.lit("unknown")), "priority": F.col("priority")}),
        counts_by(proposals, {"synthesis_source": F.col("synthesis_source")}),
        counts_by(usage, {"stage": stage, "success": F.col("success")}, F.col("total_tokens")),
    )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def child_rows(children: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[Column | str]]], key: str, most: int | None = None) -> DataFrame:
    """key, child, place, body: the entries of several child tables, given by name with the columns kept and their order, side
    by side as JSON texts; with `most` the first so many of each child of a key, which Spark sorts out before it shuffles."""
    out = None
    for name, (rows, columns, order) in children.items():
        mine = Window.partitionBy(key).orderBy(*order)
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("body")
        kept = rows.withColumn("_place", F.row_number().over(mine))
        kept = (kept.where(F.col("_place") <= most) if most else kept).select(key, F.lit(name).alias("child"), F.col("_place").alias("place"), body)
        out = kept if out is None else out.unionByName(kept)
    return out


def nested(parents: DataFrame, children: Mapping[str, tuple], key: str, most: int | None = MOST_LISTED) -> DataFrame:
    """Parents with each child as an array of JSON texts in order, and n_<child>. All children of a key meet in one shuffle,
    so their numbers add and don't multiply. Arrays hold `most` entries at most, a bound of a record; how many there are is
    told by n_<child>, and child_rows has all of them. None: no bound, for records that must hold everything."""
    entry = lambda name: F.when(F.col("child") == name, F.struct("place", "body"))
    lists = [F.transform(F.array_sort(F.collect_list(entry(n))), lambda x: x["body"]).alias(n) for n in children]
    out = parents.join(child_rows(children, key, most).groupBy(key).agg(*lists).hint("merge"), key, "left")
    every = None
    for name, (rows, _, _) in children.items():
        mine = rows.select(key, F.lit(name).alias("child"))
        every = mine if every is None else every.unionByName(mine)
    counts = every.groupBy(key).agg(*(F.count_if(F.col("child") == n).alias(f"n_{n}") for n in children))
    met = out.join(counts.hint("merge"), key, "left")
    empty = {n: F.coalesce(F.col(n), F.array().cast("array<string>")) for n in children}
    return met.withColumns(empty | {f"n_{n}": F.coalesce(f"n_{n}", F.lit(0)) for n in children})


#: What became of documents, as lists of a provenance report.
FATES = ("authoritative_documents", "retained_low_priority_documents", "downgraded_documents", "excluded_documents")


def provenance_children(treated: DataFrame, overrides: DataFrame, decisions: DataFrame) -> dict:
    """Child tables of provenance reports: documents by fate, exceptions from policies, documents that a model described,
    people's answers that were applied, decisions still open, treatment of every document."""
    leads = F.col("authority_rank") == "authoritative"
    reasons = F.coalesce("contains_unique_reasoning", F.lit(False))
    by_id = ("document_id", "doc_id")
    which = {FATES[0]: leads, FATES[1]: ~leads & reasons, FATES[2]: ~leads & ~reasons, FATES[3]: ~F.col("include_in_clean_set")}
    out = {name: (treated.where(c), ["document_id"], by_id) for name, c in which.items()}
    return out | {
        "policy_exceptions": (treated.where("coalesce(exception_reason, '') <> ''"), ["document_id", "policy_applied", "exception_reason"], by_id),
        "model_inferences": (treated.where("described_by_model"), ["document_id", "file_name_original"], by_id),
        "human_overrides_applied": (overrides, ["question_id", "field", "applied_value", "seq"], ("seq",)),
        "remaining_unresolved_decisions": (decisions, ["field", "impact"], ("field", "question_id")),
        "treatment_by_document": (treated, ["document_id", "recommended_treatment", "rag_priority"], by_id),
    }


def provenance_report(proposals: DataFrame, treated: DataFrame, overrides: DataFrame, decisions: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """One row a group (proposal_id, proposal_name, synthesis_source, document_count): lists of the children above with
    their lengths, and how often each policy was applied."""
    children = provenance_children(treated, overrides, decisions)
    policies = treated.where("policy_applied is not null").groupBy("proposal_id", "policy_applied").agg(F.count("*").alias("n"))
    applied = policies.groupBy("proposal_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("policy_applied", "n")))).alias("standing_policies_applied"))
    out = nested(proposals, children, "proposal_id", most)
    met = out.join(applied.hint("merge"), "proposal_id", "left")
    return met.withColumn("standing_policies_applied", F.coalesce("standing_policies_applied", F.create_map().cast("map<string,long>")))


def retrieval_children(lineage: DataFrame, key_documents: DataFrame, evidence: DataFrame, decisions: DataFrame) -> dict:
    by_id = ("document_id", "doc_id")
    return {
        "document_lineage": (
            lineage,
            ["document_id", "document_role", "version_status", "authority_rank", "superseded_by_document_id", "contains_unique_reasoning"], by_id,
        ),
        "key_documents": (key_documents, ["document_id", "document_role", "key_rank"], ("key_rank",)),
        "knowledge_base_treatment": (lineage, ["document_id", "recommended_treatment", "rag_priority", "policy_applied"], by_id),
        "evidence": (evidence, ["source", "document_id", "claim", "confidence"], ("source", "claim", "document_id")),
        "unresolved_decisions": (decisions, ["field", "impact"], ("field", "question_id")),
        "restricted_document_ids": (lineage.where("manual_review_required"), ["document_id"], by_id),
    }


def full_retrieval_record(proposals: DataFrame, lineage: DataFrame, key_documents: DataFrame, evidence: DataFrame, decisions: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """One row a group: its own columns, nested children, documents by retrieval priority, documents, and the sensitivity
    labels that occur."""
    children = retrieval_children(lineage, key_documents, evidence, decisions)
    label = lambda c, name: F.max(F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(name)))
    levels = [F.count_if(F.col("rag_priority") == p).alias(f"n_{p}") for p in ("high", "medium", "low", "exclude")]
    summary = lineage.groupBy("proposal_id").agg(
        *levels, F.count("*").alias("n_documents"), F.count_if("manual_review_required").alias("n_manual_review"),
        F.array_compact(F.array(label("contains_budget_or_rates", "budget_or_rates"), label("contains_personal_info", "personal_info"))).alias("labels_present"),
    )
    out = nested(proposals, children, "proposal_id", most)
    return out.join(summary.hint("merge"), "proposal_id", "left")


def request_payloads(
    proposals: DataFrame, documents: DataFrame, columns: Sequence[str], order: Sequence[str], tracker: DataFrame, policies: DataFrame,
    most_tracker: int = 20, most_policies: int = 100,
) -> DataFrame:
    """proposal_id, n_documents and payload: the request on each group as JSON, with its own columns, all of its documents in
    order, the first `most_tracker` tracker rows by id that may be its own (proposal_id, row_id, ...), and the standing
    policies, a small table that is counted before it is nested into every request."""
    held = policies.limit(most_policies + 1).collect()
    if len(held) > most_policies:
        raise ValueError(f"more than {most_policies} policies; a request holds all of them")
    standing = F.array(*(F.struct(*(F.lit(v).cast("string").alias(c) for c, v in r.asDict().items())) for r in sorted(held, key=str)))
    near = Window.partitionBy("proposal_id").orderBy("row_id")
    first = tracker.withColumn("_near", F.row_number().over(near)).where(F.col("_near") <= most_tracker)
    names = {
        "documents": (documents, list(columns), order),
        "tracker_candidates": (first, [c for c in tracker.columns if c != "proposal_id"], ("row_id",)),
    }
    out = nested(proposals, names, "proposal_id", None)  # all documents are in a request
    parsed = {n: F.transform(n, lambda t: F.parse_json(t)) for n in names}
    own = [c for c in proposals.columns]
    body = F.struct(*own, *(parsed[n].alias(n) for n in names), (standing if held else F.array().cast("array<string>")).alias("standing_policies"))
    return out.select("proposal_id", "n_documents", F.to_json(body).alias("payload"))
