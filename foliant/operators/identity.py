"""One identity per group: votes and first values of its documents, corrected by the tracker row that matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import rules
from foliant.functions import text as T
from foliant.operators import aggregates as A
from foliant.sources.tables import stored

#: Fields settled by vote, with what a tie gives; fields settled by the first value in document order.
VOTED = {"agency": "unknown", "program": "unknown", "status": "unknown", "award_status": "unknown"}
FIRST = ("submission_date", "lead_organization")


def normal_status(c: Column) -> Column:
    """The status that a tracker's wording stands for; null for other wordings."""
    token, out = T.canonical_token(F.trim(c)), F.lit(None).cast("string")
    for wording, status in rules.STATUS_ALIASES.items():
        out = F.when(token == wording, status).otherwise(out)
    return out


def given(c: Column | str) -> Column:
    """Null for an empty text."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def disagreement(field: str, own: Column, tracker: Column, differs: Column) -> Column:
    return F.when(F.coalesce(differs, F.lit(False)), F.struct(F.lit(field).alias("field"), own.alias("own_value"), tracker.alias("tracker_value")))


def matched_rows(matches: DataFrame, tracker: DataFrame) -> DataFrame:
    """(proposal_id, match_status, confidence, row_id) with the tracker's fields as tracker_<field>, null without a match."""
    fields = ("proposal_name", "submission_date", "selection_notification_date", "award_date", "status", "award_status", "result")
    side = tracker.select("row_id", *(F.col(c).alias(f"tracker_{c}") for c in fields))
    return matches.select("proposal_id", "match_status", "confidence", "row_id").join(side.hint("merge"), "row_id", "left")


def override_identity(identity: DataFrame, matched: DataFrame) -> DataFrame:
    """Identity rows (proposal_id, proposal_name, submission_date, status, award_status, ...) under a matching tracker row:
    its values win, dates of notice and award come from it alone, and what it changed is listed."""
    j = identity.join(matched.hint("merge"), "proposal_id", "left")
    name, sent = given("tracker_proposal_name"), given("tracker_submission_date")
    status = normal_status(F.col("tracker_status"))
    award = F.coalesce(given("tracker_award_status"), given("tracker_result"))
    listed = F.array_compact(
        F.array(
            disagreement("canonical_proposal_name", F.col("proposal_name"), name, name != F.col("proposal_name")),
            disagreement("submission_date", F.col("submission_date"), sent, given("submission_date") != sent),
            disagreement("status", F.col("status"), status, status != F.col("status")),
            disagreement("award_status", F.col("award_status"), award, award != F.col("award_status")),
        )
    )
    changed = {
        "proposal_name": F.coalesce(name, "proposal_name"), "submission_date": F.coalesce(sent, "submission_date"),
        "status": F.coalesce(status, "status"), "award_status": F.coalesce(award, "award_status"),
    }
    kept = [changed[c].alias(c) if c in changed else F.col(c) for c in identity.columns]
    return j.select(
        *kept, F.coalesce("match_status", F.lit("not_attempted")).alias("match_status"), "row_id",
        F.col("tracker_selection_notification_date").alias("selection_notification_date"),
        F.col("tracker_award_date").alias("award_date"), listed.alias("disagreements"),
    )


def override_documents(documents: DataFrame, matched: DataFrame) -> DataFrame:
    """Documents under the tracker row of their group: sending date, status and award status come from it; a name or date
    of notice that differs is only listed. Values that differ in case and punctuation alone agree."""
    j = documents.join(matched.hint("merge"), "proposal_id", "left")
    name, sent, notice = given("tracker_proposal_name"), given("tracker_submission_date"), given("tracker_selection_notification_date")
    status = normal_status(F.col("tracker_status"))
    award = F.coalesce(given("tracker_award_status"), given("tracker_result"))
    same = lambda a, b: T.compact(F.coalesce(a, F.lit(""))) == T.compact(b)
    pairs = (("canonical_proposal_name", name), ("submission_date", sent), ("response_date", notice), ("status", status), ("award_status", award))
    own = {f: F.col(f) if f in documents.columns else F.lit(None).cast("string") for f, _ in pairs}
    listed = F.array_compact(F.array(*(disagreement(f, own[f], v, ~same(own[f], v)) for f, v in pairs)))
    # A date of notice has authority too, and lands in the date of response.
    taken = {"submission_date": sent, "response_date": notice, "status": status, "award_status": award}
    kept = [F.coalesce(taken[c], c).alias(c) if c in taken else F.col(c) for c in documents.columns]
    more = [] if "response_date" in documents.columns else [notice.alias("response_date")]
    return j.select(
        *kept, *more, F.coalesce("match_status", F.lit("not_attempted")).alias("match_status"), F.coalesce("confidence", F.lit(0.0)).alias("match_confidence"),
        "row_id", listed.alias("disagreements"),
    )


def canonical_identity(documents: DataFrame, matched: DataFrame, order: str) -> DataFrame:
    """One row per group: name, agency, program, status and award status by vote, dates and organisation by first value,
    partners as an ordered union (of documents that have such a column), then the tracker. All votes are one grouped count;
    the branch name settles a tie of names."""
    key = "proposal_id"
    base = documents.groupBy(key).agg(
        F.min("proposal_branch").alias("proposal_branch"), F.count("*").alias("document_count"),
        *(F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in FIRST),
    )
    fields = (*VOTED, "canonical_proposal_name")
    stacked = documents.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields))).alias("x")).select(key, "x.f", "x.v")
    counted = stacked.groupBy(key, "f", F.when(A.known("v"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    top = counted.groupBy(key, "f", F.when(F.col("v").isNotNull(), F.col("n")).alias("n")).agg(F.count("*").alias("ties"), F.min("v").alias("v"))
    best = top.groupBy(key).agg(*(F.max(F.when(F.col("f") == f, F.struct("n", "ties", "v"))).alias(f"_{f}") for f in fields))
    won = lambda f: F.when((F.col(f"_{f}.ties") == 1) & F.col(f"_{f}.n").isNotNull(), F.col(f"_{f}.v"))
    out = base.join(best.hint("merge"), key).select(
        *base.columns, *(F.coalesce(won(f), F.lit(fallback)).alias(f) for f, fallback in VOTED.items()),
        F.coalesce(won("canonical_proposal_name"), "proposal_branch").alias("proposal_name"),
    )
    if "partners" in documents.columns:
        partners = A.ordered_union(documents, key, "partners", order)
        out = out.join(partners.hint("merge"), key, "left").withColumn("partners", F.coalesce("partners", F.array().cast("array<string>")))
    return override_identity(out, matched)


def proposal_summary(with_lineage: DataFrame, identity: DataFrame, order: str, texts: DataFrame | None = None) -> DataFrame:
    """The first text of a group's authoritative documents, or where there is none of its clean ones; the first of its
    commercialisation plans; all of its reviewers' texts in order; its outcome.

    Which documents these are is settled by their order alone, which is unique in a group; then texts (proposal_id, order,
    summary_short; with_lineage's own, if not given apart) meet the chosen ones, and only these go on."""
    key, rank, role = "proposal_id", F.col("authority_rank"), F.col("document_role")
    told = (with_lineage if texts is None else texts).select(key, order, F.trim("summary_short").alias("t")).where("t <> ''")
    spoken = told.select(key, order).withColumn("_told", F.lit(True))
    rows = with_lineage.select(key, order, "authority_rank", "document_role", "include_in_clean_set").join(spoken.hint("merge"), [key, order], "left")
    first = lambda condition: F.min(F.when(condition & F.col("_told"), F.col(order)))
    chosen = rows.groupBy(key).agg(
        F.bool_or(rank == "authoritative").alias("_any"), first(rank == "authoritative").alias("_a"), first(F.col("include_in_clean_set")).alias("_c"),
        first(role == "commercialization_plan").alias("_p"),
        F.collect_list(F.when((role == "review_feedback") & F.col("_told"), F.col(order))).alias("_f"),
    )
    chosen = stored(chosen)
    use = lambda o, what: F.struct(o.alias(order), F.lit(what).alias("use"))
    leading = F.when(F.col("_any"), F.col("_a")).otherwise(F.col("_c"))
    picks = F.concat(F.array(use(leading, "objective"), use(F.col("_p"), "plan")), F.transform("_f", lambda o: use(o, "feedback")))
    met = told.join(chosen.select(key, F.explode(picks).alias("x")).select(key, "x.*").hint("merge"), [key, order])
    of = lambda what, c: F.when(F.col("use") == what, c)
    said = met.groupBy(key).agg(
        F.min(of("objective", F.col("t"))).alias("technical_objective"), F.min(of("plan", F.col("t"))).alias("commercial_strategy"),
        F.transform(F.array_sort(F.collect_list(of("feedback", F.struct(order, "t")))), lambda x: x["t"]).alias("reviewer_feedback"),
    )
    outcome = identity.select(key, F.concat("status", F.lit(" ("), "award_status", F.lit(")")).alias("outcome"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return chosen.select(key).join(said.hint("merge"), key, "left").join(outcome.hint("merge"), key).select(
        key, blank("technical_objective"), blank("commercial_strategy"),
        F.coalesce("reviewer_feedback", F.array().cast("array<string>")).alias("reviewer_feedback"), "outcome",
    )


def evidence_refs(documents: DataFrame, identity: DataFrame, order: str) -> DataFrame:
    """The tracker row that a group matched, and its document surest of the name (the first of equals)."""
    row = identity.where("match_status = 'matched'").select(
        "proposal_id", F.lit("tracker").alias("source"), F.lit(None).cast("string").alias("document_id"),
        F.concat(F.lit("Tracker row "), "row_id", F.lit(" matches this group.")).alias("claim"), F.lit(0.9).alias("confidence"),
    )
    best = F.min(F.struct((-F.col("name_confidence")).alias("c"), F.col(order).alias("o"), "document_id", "canonical_proposal_name")).alias("b")
    surest = documents.groupBy("proposal_id").agg(best).select(
        "proposal_id", F.lit("document").alias("source"), F.col("b.document_id").alias("document_id"),
        F.concat(F.lit("Surest name of a document: "), "b.canonical_proposal_name").alias("claim"), (-F.col("b.c")).alias("confidence"),
    )
    return row.unionByName(surest)
