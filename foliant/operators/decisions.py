"""Open decisions: consolidation, budgets, answers, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.aggregates import first_seen


def canonical_field(field: str):
    return F.lower(F.trim(F.element_at(F.split(field, r"\."), -1)))


def consolidate(uncertain: DataFrame) -> DataFrame:
    """One decision per group and canonical field: first raw field, guess of the highest confidence (the earliest of
    equals), highest impact, number of sources, evidence in order of first appearance."""
    keyed = uncertain.withColumn("field_key", canonical_field("field"))
    main = keyed.groupBy("group_id", "field_key").agg(
        F.min_by("field", "ord").alias("field"),
        F.max(F.struct("confidence", (-F.col("ord")).alias("o"), "guess")).alias("b"),
        F.max("impact").alias("impact"), F.count("*").alias("sources"),
    )
    items = keyed.select("group_id", "field_key", "ord", F.posexplode("evidence").alias("p", "item"))
    first = items.groupBy("group_id", "field_key", "item").agg(F.min(F.struct("ord", "p")).alias("at"))
    lists = first.groupBy("group_id", "field_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), "|").alias("evidence")
    )
    return main.join(lists.hint("merge"), ["group_id", "field_key"]).select(
        "group_id", "field_key", "field", F.col("b.guess").alias("guess"), F.col("b.confidence").alias("confidence"),
        "impact", "sources", "evidence",
        F.concat(F.lit("q_"), F.substring(F.sha2(F.concat_ws("|", "group_id", F.lit("proposal"), F.lit("confirm"), "field_key"), 256), 1, 12)).alias("question_id"),
    )


#: Entries of a decision's lists; n_affected counts all documents.
MOST_LISTED = 200
#: Scopes of uncertainties that a whole group has to settle.
GROUP_SCOPES = ("proposal", "document_family")


def conflicts(documents: DataFrame, field: str, matches: DataFrame) -> DataFrame:
    """Uncertainties (group_id, field, scope, guess, confidence, impact, evidence, reason, document_id) of groups whose
    documents state two or more known values of a field and that no tracker row settles: a row for each document that
    states one. The values are made distinct by count before they are listed."""
    open_groups = documents.join(matches.where("match_status = 'matched'").select("proposal_id").hint("merge"), "proposal_id", "left_anti")
    stated = open_groups.where(F.col(field).isNotNull() & ~F.col(field).isin("", "unknown"))
    values = first_seen(stated.withColumn("_v", F.col(field)), ["proposal_id"], "_v", ["_v"], "_values", MOST_LISTED).where("size(_values) > 1")
    return stated.join(values.hint("merge"), "proposal_id").select(
        F.col("proposal_id").alias("group_id"), F.lit(f"canonical_identity.{field}").alias("field"), F.lit("proposal").alias("scope"),
        F.lit(None).cast("string").alias("guess"), F.lit(0.0).alias("confidence"), F.lit(2).alias("impact"),
        F.array(F.concat(F.lit(f"Values of {field} differ and the tracker has no row for it: "), F.array_join("_values", ", "))).alias("evidence"),
        F.lit("No tracker row decides between the values that documents state.").alias("reason"), "document_id",
    )


def consolidate_all(uncertain: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One decision per group and canonical field, of its documents' uncertainties (with ord) of group scope, then of
    conflicts found between documents.

    First raw field; guess of the highest confidence (the earliest of equals); highest impact; evidence and reasons in order
    of first appearance, each once; documents affected in order of id. The lists hold MOST_LISTED entries, n_affected says
    how many documents there are."""
    columns = ("group_id", "field", "guess", "confidence", "impact", "evidence", "reason", "document_id")
    rows = uncertain.where(F.col("scope").isin(*GROUP_SCOPES)).select(*columns, F.struct(F.lit(0).alias("late"), "ord").alias("at"))
    if found is not None:
        last = F.struct(F.lit(1).alias("late"), F.lit(None).cast(uncertain.schema["ord"].dataType).alias("ord"))
        rows = rows.unionByName(found.select(*columns, last.alias("at")))
    keys = ["group_id", "field_key"]
    keyed = rows.withColumn("field_key", canonical_field("field"))
    guesses = F.min(F.struct((-F.col("confidence")).alias("c"), "at", "guess"))
    main = keyed.groupBy(*keys).agg(
        F.min(F.struct("at", "field")).alias("f"), guesses.alias("b"), F.max("impact").alias("impact"), F.count("*").alias("sources"),
        F.count_distinct("document_id").alias("n_affected"),
    )
    items = keyed.select(*keys, "at", F.posexplode("evidence").alias("p", "item"))
    out = main.select(
        *keys, F.col("f.field").alias("field"), F.col("b.guess").alias("guess"), (-F.col("b.c")).alias("confidence"), "impact", "sources", "n_affected"
    )
    for more in (
        first_seen(items, keys, "item", ["at", "p"], "evidence", MOST_LISTED), first_seen(keyed, keys, "reason", ["at"], "reasons", MOST_LISTED),
        first_seen(keyed, keys, "document_id", ["document_id"], "affected_document_ids", MOST_LISTED),
    ):
        out = out.join(more.hint("merge"), keys, "left")
    listed = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit(""))
    question = F.sha2(F.concat_ws("|", "group_id", F.lit("proposal"), F.lit("proposal_fact"), "field_key"), 256)
    return out.withColumns(
        {
            "evidence": listed("evidence", "; "), "reasons": listed("reasons", " "),
            "affected_document_ids": F.coalesce("affected_document_ids", F.array().cast("array<string>")),
            "question_id": F.concat(F.lit("q_"), F.substring(question, 1, 12)),
        }
    )


def arbitrate(decisions: DataFrame, per_group: int = 3, per_run: int = 20, include_low: bool = False) -> DataFrame:
    """The most important questions: at most per_group of a group and per_run in all, ordered by impact, group, id. Low
    impact is dropped first. Both caps are the feature: a budget of what people are asked."""
    kept = decisions if include_low else decisions.where("impact > 0")
    mine = Window.partitionBy("group_id").orderBy(F.col("impact").desc(), "question_id")
    capped = kept.withColumn("group_rank", F.row_number().over(mine)).where(F.col("group_rank") <= per_group)
    return capped.orderBy(F.col("impact").desc(), "group_id", "question_id").limit(per_run)


def arbitration_counts(decisions: DataFrame, per_group: int = 3, per_run: int = 20) -> DataFrame:
    """One row: all decisions, dropped as low, exported and suppressed."""
    by_group = decisions.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if(F.col("impact") == 0).alias("low"))
    totals = by_group.agg(
        F.sum("n").alias("total"), F.sum("low").alias("low"),
        F.least(F.sum(F.least(F.col("n") - F.col("low"), F.lit(per_group))), F.lit(per_run)).cast("long").alias("exported"),
    )
    return totals.withColumn("suppressed", F.col("total") - F.col("exported"))


def latest_override(log: DataFrame, *key: str) -> DataFrame:
    """Last answer by log position of each key."""
    return log.groupBy(*key).agg(F.max_by("applied_value", "seq").alias("applied_value"), F.max("seq").alias("seq"))


def answer_items(c: Column) -> Column:
    """The entries of a list answer in order, each once: a JSON array, or texts parted by bars, commas or semicolons."""
    given = F.from_json(c, "array<string>")
    parted = F.when(c.startswith("["), given).otherwise(F.split(c, r"[|,;]"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parted, lambda x: F.trim(x)), lambda x: x != "")))


def same_answer(guess: Column, answer: Column, kind: Column | None = None) -> Column:
    """Whether a guess and an answer say the same: numbers by value, lists (kind `list`, or an answer that is a JSON array)
    as sets, other texts as they are but for space around them."""
    a, b = F.trim(guess), F.trim(answer)
    number = lambda c: c.try_cast("double")
    is_list = b.startswith("[") if kind is None else (b.startswith("[") | F.coalesce(kind == "list", F.lit(False)))
    numbers = F.coalesce(number(a) == number(b), F.lit(False))
    return (a == b) | numbers | (is_list & F.coalesce(answer_items(a) == answer_items(b), F.lit(False)))


def resolve_by_override(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds resolution: open without an answer, resolved if the answer says what the guess does or there is no guess, else
    reopened. A column answer_type of the decisions, if there is one, says which fields take lists."""
    joined = decisions.join(overrides.hint("merge"), ["group_id", "field_key"], "left")
    kind = F.col("answer_type") if "answer_type" in decisions.columns else None
    return joined.withColumn(
        "resolution",
        F.when(F.col("applied_value").isNull(), "open")
        .when(F.col("guess").isNull() | same_answer(F.col("guess"), F.col("applied_value"), kind), "resolved")
        .otherwise("reopened"),
    )


def usage_rows(events: DataFrame) -> DataFrame:
    """Model calls read from events: run, pass, success, tokens, latency, quota errors."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", "user_id", "ts", (1 + F.col("event_id") % 2).alias("pass_number"),
        (F.col("event_type") != "error").alias("success"), F.when(k != 0, k * 100).cast("long").alias("total_tokens"),
        (F.col("value") / 1000).alias("latency"), ((F.col("event_type") == "error") & (k >= 90)).alias("is_quota"),
    )


def usage_by_stage(usage: DataFrame) -> DataFrame:
    """Calls and tokens by pass and success, with subtotals (a null key is a total)."""
    return usage.rollup("pass_number", "success").agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.max("latency").alias("max_latency")
    )


def run_report(usage: DataFrame) -> DataFrame:
    """Independent counts by pass, by success and by quota error, in one pass over the rows."""
    return usage.select(
        F.explode(
            F.array(
                F.struct(F.lit("pass").alias("dimension"), F.col("pass_number").cast("string").alias("value")),
                F.struct(F.lit("success").alias("dimension"), F.col("success").cast("string").alias("value")),
                F.struct(F.lit("quota").alias("dimension"), F.col("is_quota").cast("string").alias("value")),
            )
        ).alias("d")
    ).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def usage_merge(usage: DataFrame) -> DataFrame:
    """Tokens of the calls of one user and pass; null only if all are."""
    return usage.groupBy("user_id", "pass_number").agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("calls"))


def halt_on_quota(usage: DataFrame, run: str = "user_id") -> DataFrame:
    """Calls that were attempted: those of a run up to and with its first quota error. A grouped minimum joined back, no
    running window over a whole run."""
    first = usage.where("is_quota").groupBy(run).agg(F.min(F.struct("ts", "event_id")).alias("_stop"))
    joined = usage.join(first.hint("merge"), run, "left")
    return joined.where(F.col("_stop").isNull() | (F.struct("ts", "event_id") <= F.col("_stop"))).drop("_stop")
