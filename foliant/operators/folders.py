"""Facts of a whole group: key documents, readiness, first values of many fields, narrative, expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.aggregates import first_seen, known

#: Entries of a narrative's lists; n_feedback says how many reviewers' texts there are.
MOST_TOLD = 50


def folder_key_documents(documents: DataFrame, roles: Sequence[str], order: str, cap: int = 10, also: Sequence[str] = ()) -> DataFrame:
    """(proposal_id, document_id, document_role, included, key_rank): for each listed role its first document of the clean set,
    or else its first one, then other documents of high priority in order, `cap` in all; `also` names further columns of theirs."""
    place = F.lit(None).cast("int")
    for i, role in enumerate(roles):
        place = F.when(F.col("document_role") == role, i).otherwise(place)
    kept, high = F.coalesce("include_in_clean_set", F.lit(False)), F.col("rag_priority") == "high"
    told = ("proposal_id", "document_id", "document_role", *also)
    rows = documents.select(*told, kept.alias("included"), high.alias("_high"), F.col(order).alias("_o"), place.alias("_role")).where("_role is not null or _high")
    mine = Window.partitionBy("proposal_id", "_role").orderBy(F.col("included").desc(), "_o")
    band = F.when(F.col("_role").isNotNull() & (F.row_number().over(mine) == 1), 0).when(F.col("_high"), 1)
    inside = Window.partitionBy("proposal_id").orderBy("_band", F.when(F.col("_band") == 0, F.col("_role")), "_o")
    ranked = rows.withColumn("_band", band).where("_band is not null").withColumn("key_rank", F.row_number().over(inside))
    return ranked.where(F.col("key_rank") <= cap).select("proposal_id", "document_id", "document_role", "included", "key_rank", *also)


def readiness(documents: DataFrame, open_critical: DataFrame, export_control: Column) -> DataFrame:
    """proposal_id, ready_for_clean_set and ready_for_future_s3: some document is in the clean set and no critical question
    (proposal_id, n_open) is open; and besides no document needs a review for export control."""
    kept = F.coalesce("include_in_clean_set", F.lit(False))
    counted = documents.groupBy("proposal_id").agg(F.count_if(kept).alias("_kept"), F.coalesce(F.bool_or(export_control), F.lit(False)).alias("_export"))
    ready = (F.col("_kept") > 0) & (F.coalesce("n_open", F.lit(0)) == 0)
    met = counted.join(open_critical.hint("merge"), "proposal_id", "left")
    return met.select("proposal_id", ready.alias("ready_for_clean_set"), (ready & ~F.col("_export")).alias("ready_for_future_s3"))


def first_known(documents: DataFrame, fields: Sequence[str], order: str) -> DataFrame:
    """proposal_id and each field's first known value in order, null if none is known. One grouped aggregate for all."""
    first = [F.min(F.when(known(f), F.struct(F.col(order).alias("o"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return documents.groupBy("proposal_id").agg(*first)


def narrative(with_lineage: DataFrame, identity: DataFrame, order: str, applications: str, targets: str, most: int = MOST_TOLD) -> DataFrame:
    """A group's narrative: objective and approach are the first short and detailed texts of its authoritative documents (of
    its clean ones if there is no authoritative one), applications and targets the ordered unions of all documents' lists,
    the strategy the first text of its commercialisation plans, feedback its reviewers' texts in order. Lists hold the first
    `most` entries, a bound of the record; n_feedback counts all."""
    key, short, detail = "proposal_id", F.trim("summary_short"), F.trim("summary_detailed")
    leads, kept = F.col("authority_rank") == "authoritative", F.coalesce("include_in_clean_set", F.lit(False))
    plans, review = F.col("document_role") == "commercialization_plan", F.col("document_role") == "review_feedback"
    at = lambda c, of: F.min(F.when(of & (c != ""), F.struct(F.col(order).alias("o"), "doc_id")))["doc_id"]
    # Only ids are grouped; the texts they stand for are fetched afterwards.
    picked = with_lineage.groupBy(key).agg(
        F.bool_or(leads).alias("_any"), at(short, leads).alias("_s1"), at(short, kept).alias("_s2"), at(detail, leads).alias("_d1"),
        at(detail, kept).alias("_d2"), at(short, plans).alias("_c"), F.count_if(review & (short != "")).alias("n_feedback"),
    )
    chosen = picked.select(
        key, "n_feedback", F.when(F.col("_any"), F.col("_s1")).otherwise(F.col("_s2")).alias("objective"),
        F.when(F.col("_any"), F.col("_d1")).otherwise(F.col("_d2")).alias("approach"), F.col("_c").alias("strategy"),
    )
    texts = with_lineage.select("doc_id", short.alias("short"), detail.alias("detail"))
    wanted = chosen.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(n).alias("doc_id")) for n in ("objective", "approach", "strategy")))).alias("x"))
    found = wanted.where("x.doc_id is not null").select(key, "x.n", "x.doc_id").join(texts.hint("merge"), "doc_id")
    text = F.when(F.col("n") == "approach", F.col("detail")).otherwise(F.col("short"))
    columns = found.groupBy(key).agg(*(F.max(F.when(F.col("n") == n, text)).alias(n) for n in ("objective", "approach", "strategy")))
    out = chosen.select(key, "n_feedback").join(columns.hint("merge"), key, "left")
    items = lambda c: with_lineage.select(key, F.col(order).alias("_o"), F.posexplode(c).alias("_p", "_item")).where("trim(_item) <> ''")
    told = with_lineage.where(review & (short != ""))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    said = told.withColumn("_n", place).where(F.col("_n") <= most).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", short.alias("t")))), lambda x: x["t"]).alias("reviewer_feedback")
    )
    for more in (
        first_seen(items(applications), [key], "_item", ["_o", "_p"], "target_applications", most),
        first_seen(items(targets), [key], "_item", ["_o", "_p"], "key_performance_targets", most), said,
        identity.select(key, F.concat("status", F.lit(" ("), "award_status", F.lit(")")).alias("outcome")),
    ):
        out = out.join(more.hint("merge"), key, "left")
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("target_applications", "key_performance_targets", "reviewer_feedback")}
    blank = {n: F.coalesce(n, F.lit("")) for n in ("objective", "approach", "strategy")}
    names = {"objective": "technical_objective", "approach": "proposed_approach", "strategy": "commercial_strategy"}
    return out.withColumns(lists | blank).withColumnsRenamed(names)


def compare_outcomes(outcomes: DataFrame, roles: DataFrame, expected: DataFrame) -> DataFrame:
    """(proposal_branch, check, expected, found) for each expectation that doesn't hold.

    outcomes: proposal_branch, status, award_status, agency, program, document_count, question_count. roles: proposal_branch,
    document_role, kind (authoritative or excluded). expected: proposal_branch and any of those values, max_question_count,
    authoritative_document_roles and excluded_from_rag_document_roles (lists); null is not checked. A branch that isn't there
    fails as a whole."""
    listed = roles.groupBy("proposal_branch").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("document_role")))).alias(f"_{k}") for k in ("authoritative", "excluded"))
    )
    own = [c for c in outcomes.columns if c != "proposal_branch"]
    side = outcomes.select("proposal_branch", F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in own))
    j = expected.join(side.hint("merge"), "proposal_branch", "left").join(listed.hint("merge"), "proposal_branch", "left")
    there, tests = F.col("_there").isNotNull(), []
    fails = lambda name, wrong, want, got: tests.append(
        F.when(wrong, F.struct(F.lit(name).alias("check"), want.cast("string").alias("expected"), got.cast("string").alias("found")))
    )
    fails("present", ~there, F.lit("true"), F.lit("false"))
    for c in ("status", "award_status", "agency", "program", "document_count"):
        if c in expected.columns and c in own:
            fails(c, there & F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c), F.col(f"_{c}"))
    if "max_question_count" in expected.columns:
        fails("max_question_count", there & (F.col("_question_count") > F.col("max_question_count")), F.col("max_question_count"), F.col("_question_count"))
    for c, kind in (("authoritative_document_roles", "authoritative"), ("excluded_from_rag_document_roles", "excluded")):
        if c in expected.columns:
            want, got = F.array_sort(F.col(c)), F.coalesce(F.col(f"_{kind}"), F.array().cast("array<string>"))
            fails(c, there & F.col(c).isNotNull() & (want != got), F.array_join(want, " "), F.array_join(got, " "))
    rows = j.select("proposal_branch", F.explode(F.array_compact(F.array(*tests))).alias("m"))
    return rows.select("proposal_branch", "m.check", "m.expected", "m.found")


def folder_page(identity: DataFrame, documents: DataFrame, key_documents: DataFrame, ready: DataFrame) -> DataFrame:
    """(proposal_id, page): a group on one Markdown page: who and what, a table of its documents by what became of them, its
    key documents (with file_name_original), how it stands with the tracker, and what it is ready for."""
    key, kept, review = "proposal_id", F.coalesce("include_in_clean_set", F.lit(False)), F.coalesce("manual_review_required", F.lit(False))
    counts = documents.groupBy(key).agg(
        F.count_if(kept).alias("_kept"), F.count_if(~kept & ~review).alias("_out"), F.count_if(review).alias("_review"), F.count("*").alias("_all")
    )
    line = F.concat(F.lit("- "), "document_role", F.lit(": "), "file_name_original", F.when(F.col("included"), "").otherwise(" (left out)"))
    keys = key_documents.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key_rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("_keys"))
    j = identity.join(counts.hint("merge"), key).join(keys.hint("merge"), key, "left").join(ready.hint("merge"), key, "left")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "yes").otherwise("no")
    differs = F.array_join(F.transform("disagreements", lambda d: d["field"]), ", ")
    sections = (
        put("# ", F.col("proposal_name")), put(F.col("agency"), " / ", F.col("program"), " / ", F.col("status"), " / ", F.col("award_status")),
        put("Led by ", F.col("lead_organization")), put("Sent on ", F.col("submission_date")),
        put("| kept | left out | under review | all |\n|-|-|-|-|\n| ", F.col("_kept"), " | ", F.col("_out"), " | ", F.col("_review"), " | ", F.col("_all"), " |"),
        F.when(F.col("_keys").isNotNull(), put("## Key documents\n", F.col("_keys"))),
        put("## Tracker\n", F.col("match_status"), F.when(differs != "", F.concat(F.lit("; differs in "), differs)).otherwise("")),
        put("## Ready\nclean set: ", yes("ready_for_clean_set"), "; storage: ", yes("ready_for_future_s3")),
    )
    return j.select(key, F.array_join(F.array_compact(F.array(*sections)), "\n\n").alias("page"))


def joined_starts(documents: DataFrame, of: dict[str, Column], text: str, order: str, most: int = 500) -> DataFrame:
    """proposal_id and for each name the texts of the documents that hold its condition, joined by spaces in order, cut after
    `most` characters, a budget of a summary. No more documents, and no more of each, are gathered than that can take."""
    key, said = "proposal_id", F.trim(text)
    named = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in of.items())))).alias("name")
    rows = documents.where(said != "").select(key, named, F.col(order).alias("_o"), F.left(said, F.lit(most)).alias("t"))
    place = F.row_number().over(Window.partitionBy(key, "name").orderBy("_o"))
    first = rows.withColumn("_n", place).where(F.col("_n") <= most)
    listed = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("_n", "t")))), lambda x: x["t"]), " ")
    met = documents.select(key).distinct().join(first.groupBy(key).agg(*(F.left(listed(n), F.lit(most)).alias(n) for n in of)).hint("merge"), key, "left")
    return met.withColumns({n: F.coalesce(n, F.lit("")) for n in of})
