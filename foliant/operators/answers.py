"""People's answers: checked against what a field takes, applied to documents and lineage, replayed from the log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant import rules
from foliant.functions import text as T
from foliant.operators.decisions import canonical_field

#: What a field takes: its allowed values, or one of boolean, list, number and text.
FIELDS: dict[str, tuple[str, ...] | str] = {
    "agency": rules.AGENCIES, "program": rules.PROGRAMS, "status": rules.STATUSES, "version_status": rules.VERSIONS,
    "rag_priority": rules.PRIORITIES, "recommended_treatment": rules.TREATMENTS, "document_category": rules.CATEGORIES,
    "include_in_clean_set": "boolean", "include_in_future_rag": "boolean", "manual_review_required": "boolean",
    "manual_review_reasons": "list", "partners": "list", "award_amount": "number", "canonical_proposal_name": "text",
    "award_status": "text", "lead_organization": "text", "submission_date": "text",
}
# Fields of a document that answers may set, by where its record holds them.
PATHS = {
    "proposal_context": (
        "canonical_proposal_name", "proposal_short_name", "agency", "agency_subunit", "program", "phase", "topic_number", "topic_title",
        "solicitation_number", "status", "award_status",
    ),
    "document_identity": ("document_category", "document_role", "origin_type", "version_status"),
    "inclusion": ("include_in_clean_set", "include_in_future_rag", "rag_priority"),
    "opportunity_treatment": ("recommended_rag_treatment",),
    "sensitivity": ("sensitivity_labels", "manual_review_required", "manual_review_reasons"),
    "": ("operator_notes",),
}
DOCUMENT_PATHS = {f: ".".join(filter(None, (at, f))) for at, fields in PATHS.items() for f in fields}
#: What each of them takes; the field of an answer about a slide deck, which needs no record.
DOCUMENT_FIELDS: dict[str, tuple[str, ...] | str] = {f: FIELDS.get(f, "text") for f in DOCUMENT_PATHS} | {
    "document_role": rules.ROLES, "origin_type": rules.ORIGINS, "recommended_rag_treatment": (*rules.TREATMENTS, "manual_review"), "sensitivity_labels": "list",
}
DECK_FIELD = "needs_powerpoint_processing"
#: Why answers are refused that would leave a record without a reason.
NO_REASON = "the record would say no reason for its inclusion"
CLOSED = ("skipped", "applied", "skip")


def get_path(path: str) -> Column:
    """A value of a nested record by its dotted path."""
    return F.col(path)


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """The records with the value at a dotted path replaced."""
    head, _, rest = path.partition(".")
    return df.withColumn(head, F.col(head).withField(rest, value) if rest else value)


def parse_options(c: Column, answer_type: Column) -> Column:
    """Choices offered with a question: a JSON list of strings, or words between commas and bars without quotes around
    them; a malformed list is read as words; a yes-no question without choices has two."""
    text = F.trim(F.coalesce(c, F.lit("")))
    listed = text.startswith("[") & text.endswith("]")
    loaded = F.when(listed, F.from_json(text, "array<string>"))
    bare = F.when(listed, F.regexp_replace(text, r"^\[|\]$", "")).otherwise(text)
    words = F.transform(F.filter(F.transform(F.split(bare, "[,|]"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.btrim(x, F.lit("\"'")))
    out = F.coalesce(F.filter(F.transform(loaded, lambda x: F.trim(x)), lambda x: x != ""), words)
    both = F.array(F.lit("true"), F.lit("false"))
    return F.when((F.size(out) == 0) & (F.lower(F.trim(answer_type)) == "boolean"), both).otherwise(out)


def with_values(answers: DataFrame, fields: Mapping[str, tuple[str, ...] | str] = FIELDS) -> DataFrame:
    """Adds value (the answer as text, lists joined by bars, booleans as true and false) and error (null if it may be
    applied) to answers (field, user_answer, status), and state: skipped, invalid or valid."""
    field, answer = F.trim("field"), F.trim(F.coalesce("user_answer", F.lit("")))
    value, error = F.lit(None).cast("string"), F.concat(F.lit("no answers are taken for this field: "), F.coalesce(field, F.lit("")))
    for name, takes in fields.items():
        mine = field == name
        if takes == "boolean":
            read = T.parse_bool(answer).cast("string")
            value, error = F.when(mine, read).otherwise(value), F.when(mine, F.when(read.isNull(), F.concat(F.lit("neither yes nor no: "), answer))).otherwise(error)
        elif takes == "list":
            read = F.array_join(T.parse_list(answer), "|")
            value, error = F.when(mine, read).otherwise(value), F.when(mine, F.when(read.isNull(), "not a list such as a | b")).otherwise(error)
        elif takes == "number":
            read = answer.try_cast("double").cast("string")
            value, error = F.when(mine, read).otherwise(value), F.when(mine, F.when(read.isNull(), F.concat(F.lit("not a number: "), answer))).otherwise(error)
        elif takes == "text":
            value, error = F.when(mine, answer).otherwise(value), F.when(mine, F.lit(None).cast("string")).otherwise(error)
        else:
            wrong = F.when(~answer.isin(*takes), F.concat(F.lit(f"no value of {name}: "), answer))
            value, error = F.when(mine & answer.isin(*takes), answer).otherwise(value), F.when(mine, wrong).otherwise(error)
    skipped = (answer == "") | F.lower(F.trim(F.coalesce("status", F.lit("open")))).isin(*CLOSED)
    out = answers.withColumn("value", F.when(~skipped, value)).withColumn("error", F.when(~skipped, error))
    return out.withColumn("state", F.when(skipped, "skipped").when(F.col("error").isNotNull(), "invalid").otherwise("valid"))


def apply_values(rows: DataFrame, key: str, values: DataFrame, order: str, fields: Sequence[str]) -> DataFrame:
    """Rows with values (key, field, value, order) applied to the named string or boolean columns: of several values of a
    field the last counts. One grouped maximum and one join."""
    last = values.groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.struct(order, "value")))["value"].alias(f"_{f}") for f in fields))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    new = {f: F.coalesce(F.col(f"_{f}").cast(kinds[f]), F.col(f)) for f in fields}
    return rows.join(last.hint("merge"), key, "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))


def apply_document_answers(documents: DataFrame, answers: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The documents with valid answers (document_id, field, user_answer, status, seq) applied, and all answers with what
    became of them: applied, invalid (with the error) or skipped. An answer to an unknown document is invalid."""
    known = documents.select("document_id").distinct().withColumn("_known", F.lit(True))
    checked = with_values(answers, {f: FIELDS[f] for f in fields}).join(known.hint("merge"), "document_id", "left")
    lost = (F.col("state") != "skipped") & F.col("_known").isNull()
    checked = checked.withColumn("error", F.when(lost, "no such document").otherwise(F.col("error"))).withColumn(
        "state", F.when(lost | (F.col("state") == "invalid"), "invalid").when(F.col("state") == "valid", "applied").otherwise("skipped")
    ).drop("_known")
    applied = checked.where("state = 'applied'").withColumn("field", F.trim("field"))
    return apply_values(documents, "document_id", applied, "seq", fields), checked


def settled_inclusion(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """(document_id, seq) of inclusion answers that can't be taken: one by one in order, an answer must leave the record with a
    reason for being included or for not being so, else it is passed over. The steps of a document are those people answered
    about it. Of rows that share an id the least record counts."""
    steps = answers.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", (F.col("field") == "include_in_clean_set").alias("clean"), (F.col("value") == "true").alias("yes")))).alias("steps")
    )
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    own = documents.groupBy("document_id").agg(
        F.min(F.struct(F.coalesce("include_in_clean_set", F.lit(False)).alias("clean"), F.coalesce("include_in_future_rag", F.lit(False)).alias("rag"),
                       given("include_reason").alias("why"), given("exclude_reason").alias("why_not"))).alias("r")
    )
    j = steps.join(own.hint("merge"), "document_id")
    seqs = F.array().cast(f"array<{answers.schema['seq'].dataType.simpleString()}>")
    start = F.struct(F.col("r.clean").alias("clean"), F.col("r.rag").alias("rag"), seqs.alias("bad"))

    def step(state: Column, x: Column) -> Column:
        clean, rag = F.when(x["clean"], x["yes"]).otherwise(state["clean"]), F.when(x["clean"], state["rag"]).otherwise(x["yes"])
        fine = F.when(clean | rag, F.col("r.why")).otherwise(F.col("r.why_not"))
        bad = F.when(fine, state["bad"]).otherwise(F.concat(state["bad"], F.array(x["seq"])))
        keep = lambda new, old: F.when(fine, new).otherwise(old)
        return F.struct(keep(clean, state["clean"]).alias("clean"), keep(rag, state["rag"]).alias("rag"), bad.alias("bad"))

    return j.select("document_id", F.explode(F.aggregate("steps", start, step)["bad"]).alias("seq"))


def apply_reviewed_answers(documents: DataFrame, answers: DataFrame, fields: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents after people's answers (question_id, document_id, field, user_answer, status, seq), all answers with state
    and error, and answers about slide decks (question_id, document_id, needs_processing, seq), which need no document.

    Any of DOCUMENT_FIELDS that documents have a column for may be set. An answer that would leave a record invalid is
    invalid itself, and later ones go by the record without it; labels must be known ones."""
    takes = {f: DOCUMENT_FIELDS[f] for f in fields or [f for f in DOCUMENT_FIELDS if f in documents.columns]}
    known = documents.select("document_id").distinct().withColumn("_known", F.lit(True))
    checked = with_values(answers, takes | {DECK_FIELD: "boolean"}).withColumn("field", F.trim("field")).join(known.hint("merge"), "document_id", "left")
    deck, there = F.col("field") == DECK_FIELD, F.col("_known").isNotNull()
    labels = F.col("field") == "sensitivity_labels"
    strange = F.size(F.array_except(F.split("value", r"\|"), F.array(*map(F.lit, rules.SENSITIVITY_LABELS)))) > 0
    error = (
        F.when(F.col("state") == "skipped", None).when(deck & ~there, F.col("error")).when(~there, "no such document")
        .when(deck, F.concat(F.lit("no answers are taken for this field: "), "field")).when(labels & F.col("error").isNull() & strange, "no known label")
        .otherwise(F.col("error"))
    )
    checked = checked.withColumn("error", error)
    open_ = (F.col("state") != "skipped") & F.col("error").isNull()
    inclusion = checked.where(open_ & F.col("field").isin("include_in_clean_set", "include_in_future_rag"))
    refused = settled_inclusion(documents, inclusion).withColumn("_refused", F.lit(True))
    judged = checked.join(refused.hint("merge"), ["document_id", "seq"], "left")
    judged = judged.withColumn("error", F.when(F.col("_refused") & open_ & F.col("field").startswith("include_in_"), NO_REASON).otherwise(F.col("error"))).withColumn(
        "state", F.when(F.col("state") == "skipped", "skipped").when(F.col("error").isNotNull(), "invalid").otherwise("applied")
    ).drop("_known", "_refused")
    applied = judged.where("state = 'applied'")
    decks = applied.where(F.col("field") == DECK_FIELD).select("question_id", "document_id", (F.col("value") == "true").alias("needs_processing"), "seq")
    return apply_typed_values(documents, applied.where(F.col("field") != DECK_FIELD), list(takes)), judged, decks


def apply_typed_values(documents: DataFrame, applied: DataFrame, fields: Sequence[str]) -> DataFrame:
    """As apply_values by document, for columns that hold lists too."""
    lists = [f.name for f in documents.schema.fields if f.name in fields and f.dataType.simpleString().startswith("array")]
    flat = documents.withColumns({c: F.array_join(c, "|") for c in lists}) if lists else documents
    out = apply_values(flat, "document_id", applied, "seq", fields)
    back = {c: F.when(F.length(c) > 0, F.split(c, r"\|")).otherwise(F.array().cast("array<string>")) for c in lists}
    return out.withColumns(back) if lists else out


def replay_overrides(documents: DataFrame, log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Documents with a log of overrides (field, decision_type, affected_document_ids, applied_value, seq) replayed; choices
    of an authoritative document are not theirs to take."""
    each = log.where("decision_type <> 'authoritative_document'").select(
        F.explode("affected_document_ids").alias("document_id"), F.lower(F.trim(F.element_at(F.split("field", r"\."), -1))).alias("field"),
        F.col("applied_value").alias("value"), "seq",
    )
    return apply_values(documents, "document_id", each, "seq", fields)


def choose_authoritative(lineage: DataFrame, choices: DataFrame) -> DataFrame:
    """Lineage rows after choices (proposal_id, chosen, affected_document_ids, seq) of the authoritative document: the
    chosen one leads, other affected ones that aren't excluded support it and point to it. The last choice of a document
    counts, of choices of one seq the greatest."""
    each = choices.select("proposal_id", "chosen", "seq", F.explode("affected_document_ids").alias("document_id"))
    last = each.groupBy("proposal_id", "document_id").agg(F.max_by("chosen", F.struct("seq", "chosen")).alias("_chosen"))
    j = lineage.join(last.hint("merge"), ["proposal_id", "document_id"], "left")
    leads = F.col("_chosen") == F.col("document_id")
    follows = F.col("_chosen").isNotNull() & ~leads & (F.col("authority_rank") != "excluded")
    new = {
        "authority_rank": F.when(leads, "authoritative").when(follows, "supporting").otherwise(F.col("authority_rank")),
        "superseded_by_document_id": F.when(leads, F.lit(None)).when(follows, F.col("_chosen")).otherwise(F.col("superseded_by_document_id")),
    }
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in lineage.columns))


def check_proposal_answers(groups: DataFrame, answers: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Answers of group scope (proposal_id, field, decision_type, affected_document_ids, user_answer, status, seq) with field
    as its canonical key, value, previous_value, error, and state: applied, invalid or skipped. previous_value is the
    applied value before it, or the group's own; null for a choice of an authoritative document."""
    known = groups.select("proposal_id", F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("_own"))
    keyed = answers.withColumns({"_given": F.trim(F.coalesce("field", F.lit(""))), "field": canonical_field("field")})
    read = with_values(keyed, {f: FIELDS[f] for f in fields}).join(known.hint("merge"), "proposal_id", "left")
    skipped, answer = F.col("state") == "skipped", F.trim("user_answer")
    choice = F.coalesce(F.col("decision_type") == "authoritative_document", F.lit(False))
    among = F.coalesce(F.array_contains("affected_document_ids", answer), F.lit(False))
    error = (
        F.when(skipped, None).when(F.col("_own").isNull(), "no such group")
        .when(F.col("_given") == "", "the answer names no field")
        .when(choice & ~among, F.concat(F.lit("not among the documents asked about: "), F.array_join("affected_document_ids", ", ")))
        .when(choice, None).when(~F.col("field").isin(*fields), F.concat(F.lit("groups take no answers for: "), "_given")).otherwise(F.col("error"))
    )
    judged = read.withColumn("error", error).withColumns(
        {
            "value": F.when(choice & ~skipped, answer).otherwise(F.col("value")),
            "state": F.when(skipped, "skipped").when(F.col("error").isNotNull(), "invalid").otherwise("applied"),
            "_choice": choice,
        }
    )
    before = F.last(F.when(F.col("state") == "applied", F.col("value")), ignorenulls=True).over(
        Window.partitionBy("proposal_id", "field", "_choice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    own = F.coalesce(*(F.when(F.col("field") == f, F.col("_own")[f]) for f in fields))
    previous = F.when((F.col("state") == "applied") & ~F.col("_choice"), F.coalesce(before, own))
    return judged.withColumn("previous_value", previous).drop("_given", "_own", "_choice")


def affected(log: DataFrame) -> DataFrame:
    """(document_id, field, value, seq) of the documents that applied facts of a checked log touch."""
    facts = log.where("state = 'applied' and not decision_type <=> 'authoritative_document'")
    return facts.select(F.explode("affected_document_ids").alias("document_id"), "field", "value", "seq")


def apply_proposal_answers(
    groups: DataFrame, documents: DataFrame, lineage: DataFrame, answers: DataFrame, fields: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Groups, their affected documents and lineage after answers of group scope, and the log of all answers. Facts go to the
    group and to the affected documents, choices of an authoritative document to the lineage; the last answer counts."""
    log = check_proposal_answers(groups, answers, fields)
    facts = log.where("state = 'applied' and not decision_type <=> 'authoritative_document'")
    chosen = log.where("state = 'applied' and decision_type <=> 'authoritative_document'")
    return (
        apply_values(groups, "proposal_id", facts, "seq", fields),
        apply_values(documents, "document_id", affected(log), "seq", fields),
        choose_authoritative(lineage, chosen.select("proposal_id", F.col("value").alias("chosen"), "affected_document_ids", "seq")),
        log,
    )


def clear_uncertainties(uncertain: DataFrame, log: DataFrame) -> DataFrame:
    """Uncertainties (document_id, field, ...) but those that an applied fact has settled: same document, same field key."""
    settled = affected(log).select("document_id", F.col("field").alias("_key")).distinct()
    keyed = uncertain.withColumn("_key", canonical_field("field"))
    return keyed.join(settled.hint("merge"), ["document_id", "_key"], "left_anti").select(*uncertain.columns)
