"""A second look at uncertain documents: who needs it, what it sees, and what of it is taken over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import is_unknown


def needs_review(threshold: float, optional: Sequence[Column] = ()) -> Column:
    """Not seen twice yet, and: category, role or retrieval below the threshold, an unknown origin or name, or a flag.
    `optional` are more conditions of the caller's."""
    low = (F.col("category_confidence") < threshold) | (F.col("role_confidence") < threshold) | (F.col("rag_confidence") < threshold)
    wanted = low | is_unknown(F.col("origin_type")) | is_unknown(F.col("canonical_proposal_name"))
    for condition in optional:
        wanted = wanted | F.coalesce(condition, F.lit(False))
    return ~F.col("reviewed_twice") & wanted


def adopt(old: Column, new: Column, old_confidence: Column, new_confidence: Column, threshold: float, explained: Column) -> Column:
    """Whether a new value replaces the old one: never an unknown one; for an unknown one if sure enough; for a sure one
    only with an explanation and more confidence; else with more confidence."""
    surer = new_confidence > old_confidence
    return (
        F.when(is_unknown(new), False)
        .when(is_unknown(old), new_confidence >= threshold)
        .when(old_confidence >= threshold, explained & surer)
        .otherwise(surer)
    )


def merge_passes(
    first: DataFrame, second: DataFrame, key: str, fields: Sequence[tuple[str, str]], threshold: float = 0.75
) -> DataFrame:
    """`first` with the values of `second` that are adopted, field by field, given as (value, confidence) columns. Equal
    values keep the higher confidence. `changes` lists what was replaced. `second` has one row per key, and columns
    explained and reason; rows without one stay as they are."""
    new = second.select(
        key, F.lit(True).alias("_given"), F.col("explained").alias("_explained"), F.col("reason").alias("_reason"),
        *(F.col(c).alias(f"_{c}") for pair in fields for c in pair),
    )
    joined = first.join(new.hint("merge"), key, "left")
    merged, changes = {}, []
    for value, confidence in fields:
        old, now, c1, c2 = F.col(value), F.col(f"_{value}"), F.col(confidence), F.col(f"_{confidence}")
        same = old.eqNullSafe(now)
        take = F.coalesce(F.col("_given") & ~same & adopt(old, now, c1, c2, threshold, F.col("_explained")), F.lit(False))
        merged[value] = F.when(take, now).otherwise(old)
        merged[confidence] = F.when(take, c2).when(same, F.greatest(c1, c2)).otherwise(c1)
        changes.append(
            F.when(
                take,
                F.struct(
                    F.lit(value).alias("field_path"), old.alias("old_value"), now.alias("new_value"),
                    F.format_string("%.2f", c1).alias("old_confidence"), F.format_string("%.2f", c2).alias("new_confidence"),
                    F.col("_reason").alias("reason"),
                ),
            )
        )
    kept = [c for c in first.columns if c not in merged]
    return joined.select(*kept, *(c.alias(n) for n, c in merged.items()), F.array_compact(F.array(*changes)).alias("changes"))


#: Values of a record that a second pass may replace, with their confidences.
MERGED = tuple((v, f"{v}_confidence") for v in (
    "document_category", "document_role", "origin_type", "version_status", "canonical_proposal_name", "agency", "program", "status",
    "award_status", "include_in_clean_set", "include_in_future_rag", "rag_priority",
))
# Why a row of the log of changes is there, and the note on a merged record.
ADOPTED, RAISED, REPLACED = "pass2_value_adopted", "confidence_increased_with_same_value", "pass2_uncertainties_replaced"
NOTE = "pass2_context_review_applied"


def merge_records(first: DataFrame, second: DataFrame, key: str, fields: Sequence[tuple[str, str]] = MERGED, threshold: float = 0.75) -> DataFrame:
    """Records after a second pass, with changes (field_path, old and new value and confidence, reason) and history.

    Both have the values and confidences of `fields`, uncertainties (a list of any kind) and processing_notes (a list of
    texts); `second` has one row per key. Values go by `adopt`; equal ones keep the higher confidence; a null confidence is
    0; a second pass that has notes explains itself. Uncertainties are the second pass's. Notes are those of both in order,
    each once, and one on the merge. `history` holds the first record, the second and the merged one as variants. Records
    without a second one stay as they are, with an empty history."""
    names = [*(c for pair in fields for c in pair), "uncertainties", "processing_notes"]
    side = second.select(key, F.lit(True).alias("_given"), *(F.col(c).alias(f"_{c}") for c in names))
    joined = first.join(side.hint("merge"), key, "left")
    given, new, changes = F.coalesce("_given", F.lit(False)), {}, []
    text = lambda c: c.cast("string")
    row = lambda when, path, old, now, c1, c2, why: F.when(
        when,
        F.struct(
            F.lit(path).alias("field_path"), text(old).alias("old_value"), text(now).alias("new_value"), c1.alias("old_confidence"),
            c2.alias("new_confidence"), F.lit(why).alias("reason"),
        ),
    )
    notes = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    explained = F.size(notes("_processing_notes")) > 0
    for value, confidence in fields:
        old, now = F.col(value), F.col(f"_{value}")
        c1, c2 = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (confidence, f"_{confidence}"))
        same = old.eqNullSafe(now)
        take = F.coalesce(given & ~same & adopt(text(old), text(now), c1, c2, threshold, explained), F.lit(False))
        rise = given & same & (c2 > c1)
        new[value] = F.when(take, now).otherwise(old)
        new[confidence] = F.when(take | rise, c2).otherwise(F.col(confidence))
        changes += [row(rise, confidence, c1, c2, c1, c2, RAISED), row(take, value, old, now, c1, c2, ADOPTED)]
    as_json = lambda c: F.to_json(F.struct(F.coalesce(F.col(c), F.array()).alias("u")))
    other = given & (as_json("uncertainties") != as_json("_uncertainties"))
    zero = F.lit(0.0)
    changes.append(row(other, "uncertainties", as_json("uncertainties"), as_json("_uncertainties"), zero, zero, REPLACED))
    new["uncertainties"] = F.when(given, F.col("_uncertainties")).otherwise(F.col("uncertainties"))
    both = F.array_distinct(F.concat(notes("processing_notes"), notes("_processing_notes")))
    new["processing_notes"] = F.when(given, F.concat(both, F.array(F.lit(NOTE)))).otherwise(F.col("processing_notes"))
    kept = [c for c in first.columns if c not in new]
    out = joined.select(
        *kept, *(c.alias(n) for n, c in new.items()), F.array_compact(F.array(*changes)).alias("changes"), given.alias("_given"),
        F.struct(*(F.col(c) for c in names)).alias("_first"), F.struct(*(F.col(f"_{c}").alias(c) for c in names)).alias("_second"),
    )
    shot = lambda stage, c: F.struct(F.lit(stage).alias("stage"), F.parse_json(F.to_json(c)).alias("record"))
    shots = F.array(shot("pass1", F.col("_first")), shot("pass2_candidate", F.col("_second")), shot("pass2_merged", F.struct(*(F.col(c) for c in names))))
    return out.withColumn("history", F.when(F.col("_given"), shots).otherwise(F.slice(shots, 1, 0))).drop("_given", "_first", "_second")


def change_log(merged: DataFrame, key: str) -> DataFrame:
    """One row per replaced value."""
    return merged.select(key, F.explode("changes").alias("c")).select(key, "c.*")


def branch_signals(documents: DataFrame, field: str, order: str) -> DataFrame:
    """Adds suggested: the most common known value of the field among the other documents of the group, of equally common
    ones the one seen first. Values are counted by group, so a document is compared with values, not with documents."""
    places = Window.partitionBy("proposal_id", "v").orderBy("o")
    seen = documents.where(~is_unknown(F.col(field))).select("proposal_id", F.col(field).alias("v"), F.col(order).alias("o"))
    second = seen.withColumn("_p", F.row_number().over(places)).where("_p = 2").select("proposal_id", "v", F.col("o").alias("o2"))
    counted = seen.groupBy("proposal_id", "v").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    counted = counted.join(second.hint("merge"), ["proposal_id", "v"], "left")
    # Without its own vote a value falls by one, so the best other value is among the group's two best or its own.
    best_first = Window.partitionBy("proposal_id").orderBy(F.col("n").desc(), "o")
    top = counted.withColumn("r", F.row_number().over(best_first)).where("r <= 2")
    pick = lambda r: F.max(F.when(F.col("r") == r, F.struct("n", "v", "o", "o2")))
    best = top.groupBy("proposal_id").agg(pick(1).alias("_a"), pick(2).alias("_b"))
    own, a, b = F.col(field), F.col("_a"), F.col("_b")
    left, since = a["n"] - 1, F.when(a["o"] == F.col(order), a["o2"]).otherwise(a["o"])
    other = b["n"].isNotNull() & ((b["n"] > left) | ((b["n"] == left) & (b["o"] < since)))
    return documents.join(best.hint("merge"), "proposal_id", "left").withColumn(
        "suggested", F.when(~own.eqNullSafe(a["v"]), a["v"]).when(other, b["v"]).when(left > 0, a["v"])
    ).drop("_a", "_b")


def context_neighbours(documents: DataFrame, threshold: float = 0.75, fallback: int = 5) -> DataFrame:
    """(proposal_id, target, neighbour, score): what the second look at a document is shown. Confident documents of a group
    are shown to all others of it, as one row each without a target (nobody is shown itself). A document with no confident
    one beside it gets the `fallback` best others, as rows of its own; so rows grow with documents, not with pairs."""
    score = F.greatest("category_confidence", "role_confidence")
    rows = documents.select("proposal_id", "doc_id", "document_id", "scan_ord", score.alias("score"))
    sure = rows.where(F.col("score") >= threshold)
    shared = sure.select("proposal_id", F.lit(None).cast("long").alias("target"), F.col("doc_id").alias("neighbour"), "score")
    number = sure.groupBy("proposal_id").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_only"))
    best = Window.partitionBy("proposal_id").orderBy(F.col("score").desc(), "document_id", "scan_ord")
    top = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= fallback + 1)
    shown = top.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("_r", "doc_id", "score"))).alias("_top"))
    alone = rows.join(number.hint("merge"), "proposal_id", "left").where("_n is null or (_n = 1 and _only = doc_id)")
    others = F.slice(F.filter("_top", lambda x: x["doc_id"] != F.col("doc_id")), 1, fallback)
    own = alone.join(shown.hint("merge"), "proposal_id").select("proposal_id", "doc_id", F.explode(others).alias("x"))
    own = own.select("proposal_id", F.col("doc_id").alias("target"), F.col("x.doc_id").alias("neighbour"), F.col("x.score").alias("score"))
    return shared.unionByName(own)


def review_again(documents: DataFrame) -> DataFrame:
    """The default second opinion on documents with columns suggested_<field> for name, agency and program: support letters
    and unknown roles become letters, unknown identity is filled from the group, confidences get floors."""
    letter = F.lower("file_name_original").contains("support letter") | F.col("document_role").isin("letter_of_support", "unknown")
    filled = lambda c: F.when(is_unknown(F.col(c)) & ~is_unknown(F.col(f"suggested_{c}")), F.col(f"suggested_{c}")).otherwise(F.col(c))
    name = filled("canonical_proposal_name")
    floor = lambda c, least: F.greatest(F.col(c), F.lit(least))
    return documents.withColumns(
        {
            "document_category": F.when(letter, "partner_document").otherwise(F.col("document_category")),
            "document_role": F.when(letter, "letter_of_support").otherwise(F.col("document_role")),
            "origin_type": F.when(letter, "generated_response").otherwise(F.col("origin_type")),
            "category_confidence": F.when(letter, floor("category_confidence", 0.92)).otherwise(F.col("category_confidence")),
            "role_confidence": F.when(letter, floor("role_confidence", 0.95)).otherwise(F.col("role_confidence")),
            "canonical_proposal_name": F.when(is_unknown(name), F.col("proposal_branch")).otherwise(name),
            "agency": filled("agency"), "program": filled("program"),
            "name_confidence": floor("name_confidence", 0.9), "rag_confidence": floor("rag_confidence", 0.8),
        }
    )
