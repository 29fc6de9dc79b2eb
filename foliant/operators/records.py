"""Records of a group and of a run: folder roll-ups and their text, manifests, the gate, expectations, counts, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import aggregates as A
from foliant.operators.responses import as_variants, is_text, text_at

PRIORITIES = ("low", "medium", "high", "critical")
#: Review rows in one of these states are settled.
RESOLVED = ("applied", "suppressed", "skipped", "skip")
#: Documents whose short summaries a folder's detailed one quotes whole: a budget of a text that people read.
MOST_QUOTED = 5


def question_text(field: Column, name: Column, group: Column, guess: Column, reason: Column) -> Column:
    seen = F.coalesce(F.concat(F.lit(" So far it looks like '"), F.nullif(guess, F.lit("")), F.lit("'.")), F.lit(""))
    asked = F.concat(F.lit("Which "), field, F.lit(" holds for "), name, F.lit(" ("), group, F.lit(")?"))
    return F.trim(F.concat(asked, seen, F.lit(" "), F.coalesce(reason, F.lit(""))))


def build_questions(decisions: DataFrame, options: dict[str, tuple[str, ...] | str]) -> DataFrame:
    """Questions for people from decisions (question_id, group_id, field, field_key, guess, impact, resolution): text,
    priority, choices and answer type of the field, and why; a reopened one says so."""
    choices, kind = F.lit(None).cast("string"), F.lit("string")
    for name, takes in options.items():
        mine = F.col("field_key") == name
        if isinstance(takes, tuple):
            choices, kind = F.when(mine, " | ".join(sorted(takes))).otherwise(choices), F.when(mine, "enum").otherwise(kind)
        elif takes == "list":
            kind = F.when(mine, "list").otherwise(kind)
    why = F.lit("The documents leave it open.")
    reopened = F.concat(F.lit("Asked again, since documents now say otherwise. "), why)
    group = F.col("group_id").cast("string")
    return decisions.where("resolution <> 'resolved'").select(
        "question_id", "group_id", "field",
        question_text(F.col("field"), F.concat(F.lit("Group "), group), group, F.col("guess"), F.lit("")).alias("question"),
        F.element_at(F.array(*map(F.lit, PRIORITIES)), F.col("impact") + 1).alias("priority"), choices.alias("suggested_options"),
        kind.alias("answer_type"), F.when(F.col("resolution") == "reopened", reopened).otherwise(why).alias("why"),
    )


def export_questions(sources: list[DataFrame], include_low: bool = False) -> DataFrame:
    """Questions (question_id, priority, ...) of several sources: low ones dropped, of repeated ids the first source's, and
    there the least row in the order of its columns."""
    columns = sources[0].columns
    every = sources[0].withColumn("_source", F.lit(0))
    for i, more in enumerate(sources[1:], 1):
        every = every.unionByName(more.withColumn("_source", F.lit(i)))
    kept = every if include_low else every.where("priority <> 'low'")
    rest = [c for c in columns if c != "question_id"]
    first = kept.groupBy("question_id").agg(F.min(F.struct("_source", *rest)).alias("r"))
    return first.select("question_id", "r.*").select(*columns)


REWORDED = ("question", "suggested_options", "why")


def refine_questions(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Questions (group_id, question_id, question, suggested_options, why, ...) after a model's word on them. Responses
    (group_id, body) hold a list `questions` of objects with question_id and new wordings: those of known ids stay, with
    the texts that aren't blank taken over; questions left out go. A group for which nothing usable is said keeps its own."""
    item = F.col("_item")
    said = lambda k: F.when(is_text(F.try_variant_get(item, f"$.{k}", "variant")), text_at(item, k))
    items = responses.select("group_id", F.explode(as_variants(F.col("body"), "$.questions")).alias("_item")).select(
        "group_id", said("question_id").alias("question_id"), *(said(k).alias(f"_{k}") for k in REWORDED)
    )
    met = questions.join(items.hint("merge"), ["group_id", "question_id"])
    new = {k: F.coalesce(f"_{k}", k) for k in REWORDED}
    refined = met.select(*(new[c].alias(c) if c in new else F.col(c) for c in questions.columns))
    silent = questions.join(met.select("group_id").distinct().hint("merge"), "group_id", "left_anti")
    return refined.unionByName(silent.select(*questions.columns))


def open_critical(sources: list[DataFrame], review: DataFrame, applied: DataFrame, overridden: DataFrame) -> DataFrame:
    """Critical questions that block a clean set: of documents (all sources but the last), then of the review sheet
    (question_id, priority, status), then arbitrated ones (the last source). Left out are applied ones, documents'
    questions that the sheet settled, and arbitrated ones that the override log answers."""
    ids = lambda df: df.select("question_id").hint("merge")
    state = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    settled = review.where(state.isin(*RESOLVED))
    columns = ("question_id", "proposal_id", "field")
    parts = []
    for i, found in enumerate(sources[:-1]):
        parts.append(found.where("priority = 'critical'").join(ids(settled), "question_id", "left_anti").select(*columns).withColumn("_source", F.lit(i)))
    open_rows = review.where(~state.isin(*RESOLVED) & (F.lower(F.trim("priority")) == "critical"))
    parts.append(open_rows.select(*columns).withColumn("_source", F.lit(len(sources))))
    last = sources[-1].where("priority = 'critical'").join(ids(overridden), "question_id", "left_anti").select(*columns)
    blocked = parts[0]
    for part in parts[1:]:
        blocked = blocked.unionByName(part)
    blocked = blocked.join(ids(applied), "question_id", "left_anti").unionByName(last.withColumn("_source", F.lit(len(sources) + 1)))
    first = blocked.groupBy("question_id").agg(F.min(F.struct("_source", "proposal_id", "field")).alias("r"))
    return first.select("question_id", "r.proposal_id", "r.field")


def critical_gate(blocked: DataFrame, allow_open: bool = False) -> None:
    """Raises if a critical question is open. One row is looked at."""
    if not allow_open and (row := blocked.first()):
        raise RuntimeError(f"critical questions are open, such as {row.question_id}")


def missing_sources(planned: DataFrame, listing: DataFrame) -> DataFrame:
    """Planned files that the current listing doesn't have."""
    return planned.join(listing.select("relative_path").hint("merge"), "relative_path", "left_anti").select(
        "document_id", "relative_path", F.lit("source_file_missing").alias("reason")
    )


def document_manifest(documents: DataFrame, lineage: DataFrame, planned: DataFrame) -> DataFrame:
    """Every document with its lineage and treatment, or its own values where a stale lineage lacks it, and where it lies in
    the clean set (null if it was left out)."""
    marks = lineage.select("doc_id", F.lit(True).alias("_in"), "authority_rank", "superseded_by_document_id", "contains_unique_reasoning", "recommended_treatment")
    j = documents.join(marks.hint("merge"), "doc_id", "left").join(planned.select("doc_id", "clean_path").hint("merge"), "doc_id", "left")
    other = lambda c, value: F.when(F.col("_in"), F.col(c)).otherwise(value).alias(c)
    return j.select(
        "doc_id", "document_id", "proposal_id", "file_name_original", "document_role", "version_status", "rag_priority",
        other("authority_rank", "supporting"), other("superseded_by_document_id", F.lit(None)),
        F.coalesce(other("contains_unique_reasoning", False), F.lit(False)).alias("contains_unique_reasoning"),
        other("recommended_treatment", "metadata_only"), "clean_path",
    )


def folder_records(documents: DataFrame, identity: DataFrame, order: str, texts: DataFrame | None = None) -> DataFrame:
    """A folder's record: its group's identity, counts, roles, and summaries made of its first kept documents' texts.

    Which documents are quoted is settled by their order alone; texts (proposal_id, order, file_name_original, summary_short;
    the documents' own, if not given apart) meet their group's list in one shuffle. The order is unique in a group."""
    key, short = "proposal_id", F.trim("summary_short")
    kept = F.col("include_in_clean_set")
    counts = documents.groupBy(key).agg(
        F.count("*").alias("n_documents"), F.count_if(kept).alias("n_included"), F.count_if(F.col("manual_review_required")).alias("n_review"),
        F.count_if(F.col("sensitive")).alias("n_sensitive"),
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = documents.where(kept).select(key, order).withColumn("_n", place).where(F.col("_n") <= MOST_QUOTED)
    quoted = first.groupBy(key).agg(F.collect_list(order).alias("_quoted"))
    line = F.concat(F.lit("**"), "file_name_original", F.lit("**: "), short)
    told = (documents if texts is None else texts).where(short != "").select(key, order, line.alias("t"))
    met = told.join(quoted.hint("merge"), key).where(F.array_contains("_quoted", F.col(order)))
    details = met.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t"))), lambda x: x["t"]), "\n\n").alias("summary_detailed")
    )
    roles = A.counter_map(documents, key, "document_role").withColumnRenamed("counts", "roles")
    out = identity.drop("document_count").join(counts.hint("merge"), key).join(details.hint("merge"), key, "left").join(roles.hint("merge"), key)
    sentence = F.concat(
        "proposal_name", F.lit(": "), "program", F.lit(" application to "), "agency", F.lit(", "), "status", F.lit("; documents kept: "),
        F.col("n_included").cast("string"),
    )
    return out.withColumn("summary_sentence", sentence).withColumn("summary_detailed", F.coalesce("summary_detailed", F.lit("")))


def folder_markdown(folders: DataFrame) -> DataFrame:
    """The folder's record as Markdown; lines without a value are left out."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    lines = (
        text("# ", F.col("proposal_name")), text("**Group:** ", F.col("proposal_id")),
        text("**Agency:** ", F.col("agency"), " | **Program:** ", F.col("program")),
        text("**Status:** ", F.col("status"), " | **Award:** ", F.col("award_status")),
        text("**Submitted:** ", F.col("submission_date")), text("**Lead:** ", F.col("lead_organization")),
        F.when(F.size("partners") > 0, text("**Partners:** ", F.array_join(F.slice("partners", 1, 10), ", "))),
        text("## Summary"), F.col("summary_sentence"), F.nullif("summary_detailed", F.lit("")),
        text("## Roles"),
        F.array_join(F.transform(F.map_entries("roles"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string"))), "\n"),
    )
    return folders.select("proposal_id", F.array_join(F.array_compact(F.array(*lines)), "\n\n").alias("markdown"))


def retrieval_summary(treated: DataFrame) -> DataFrame:
    """What a group's retrieval record says of its documents: sensitivity labels, reviews, priorities. Restricted documents
    are rows of the treatment table, not a list that grows with the group."""
    label = F.array_compact(F.array(F.when(F.col("contains_budget_or_rates"), "budget_or_rates"), F.when(F.col("contains_personal_info"), "personal_info")))
    level = [F.count_if(F.col("rag_priority") == p).alias(f"n_{p}") for p in ("high", "medium", "low", "exclude")]
    return treated.withColumn("_l", label).groupBy("proposal_id").agg(
        F.array_sort(F.array_distinct(F.concat(
            F.when(F.bool_or(F.array_contains("_l", "budget_or_rates")), F.array(F.lit("budget_or_rates"))).otherwise(F.array().cast("array<string>")),
            F.when(F.bool_or(F.array_contains("_l", "personal_info")), F.array(F.lit("personal_info"))).otherwise(F.array().cast("array<string>")),
        ))).alias("labels_present"),
        F.count_if("manual_review_required").alias("manual_review_required_count"), *level, F.count("*").alias("document_count"),
    )


def evaluate_expectations(identity: DataFrame, roles: DataFrame, expected: DataFrame) -> DataFrame:
    """(proposal_branch, mismatches) of expected rows (proposal_branch, status, award_status, agency, program,
    document_count, authoritative_roles, each null if not asserted) against identities and (proposal_id, document_role) of
    authoritative documents. A branch that nobody synthesised is a mismatch."""
    names = ("status", "award_status", "agency", "program", "document_count")
    listed = roles.distinct().groupBy("proposal_id").agg(F.array_sort(F.collect_list("document_role")).alias("_roles"))
    got = identity.join(listed.hint("merge"), "proposal_id", "left").select(
        "proposal_branch", F.lit(True).alias("_found"), F.coalesce("_roles", F.array().cast("array<string>")).alias("_roles"), *(F.col(c).cast("string").alias(f"_{c}") for c in names)
    )
    j = expected.join(got.hint("merge"), "proposal_branch", "left")
    say = lambda c, want, have: F.concat(F.lit(f"{c}: expected "), want, F.lit(", got "), have)
    tests = [F.when(F.col("_found").isNull(), "not synthesised")]
    for c in names:
        want = F.col(c).cast("string")
        tests.append(F.when(F.col("_found") & want.isNotNull() & ~want.eqNullSafe(F.col(f"_{c}")), say(c, want, F.coalesce(f"_{c}", F.lit("nothing")))))
    want = F.array_sort("authoritative_roles")
    tests.append(F.when(F.col("_found") & (want != F.col("_roles")), say("authoritative_roles", F.array_join(want, " "), F.array_join("_roles", " "))))
    return j.select("proposal_branch", F.array_compact(F.array(*tests)).alias("mismatches"))


def stage_counts(run_id: str, counted: dict[str, DataFrame]) -> DataFrame:
    """(run_id, stage, metric, value): the columns of one-row tables of counts, by the stage that made them."""
    out = None
    for stage, counts in counted.items():
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in counts.columns))
        rows = counts.select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), F.explode(pairs).alias("p")).select("run_id", "stage", "p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def latest_run(rows: DataFrame) -> DataFrame:
    """Rows of the newest run: the last run_id in lexical order."""
    return rows.join(F.broadcast(rows.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")


def run_manifest(log: DataFrame) -> DataFrame:
    """The last audit row of each run (run_id, seq, ...)."""
    rest = [c for c in log.columns if c not in ("run_id", "seq")]
    return log.groupBy("run_id").agg(F.max(F.struct("seq", *rest)).alias("r")).select("run_id", "r.*")


def request_packets(documents: DataFrame, identity: DataFrame, order: str) -> DataFrame:
    """The request on a group as JSON: its identity and all its documents in order."""
    parts = documents.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_n"), "document_id", "document_role"))).alias("d"))
    body = F.struct("proposal_name", "status", F.transform("d", lambda x: F.struct(x["document_id"].alias("document_id"), x["document_role"].alias("role"))).alias("documents"))
    return identity.join(parts.hint("merge"), "proposal_id").select("proposal_id", F.to_json(body).alias("payload"))
