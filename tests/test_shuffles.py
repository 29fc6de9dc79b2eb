"""What queries of groups send through shuffles: orders once, texts where they are read, and only those that are chosen."""

import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import identity as Y
from foliant.operators import records as K
from foliant.plans import registry
from foliant.plans.records import matched
from foliant.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def inputs(df, kinds):
    """Names of the columns that go into each node of these kinds in the optimised plan."""
    out, waiting = [], [df._jdf.queryExecution().optimizedPlan()]
    while waiting:
        node = waiting.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() in kinds:
            out.append({c.output().apply(i).name() for c in children for i in range(c.output().size())})
        waiting += children
    return out


def test_the_tracker_view_reads_orders_once(spark):
    plan = X.tracker(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey#") > 0 and len([r for r in plan.splitlines() if "Relation" in r and "o_orderkey" in r]) == 1


def test_labels_are_joined_without_texts(spark):
    joins = inputs(registry.documents(spark, SF).select("doc_id", "partners", "h"), {"Join"})
    assert joins and not any({"text", "summary_short", "sha256"} & names for names in joins)


DOCUMENTS = "proposal_id string, ord string, authority_rank string, document_role string, include_in_clean_set boolean, summary_short string, file_name_original string, manual_review_required boolean, sensitive boolean"
ROWS = [
    ("p", "1", "authoritative", "budget", True, "  ", "a", False, True), ("p", "2", "authoritative", "review_feedback", False, " two ", "b", False, False),
    ("p", "3", "supporting", "commercialization_plan", True, "three", "c", True, False), ("p", "4", "supporting", "review_feedback", True, "four", "d", False, False),
    ("q", "1", "supporting", "budget", False, "left out", "e", False, False), ("q", "2", "supporting", "commercialization_plan", True, "kept", "f", False, False),
    ("r", "1", "authoritative", "budget", True, "", "g", False, False),
]
IDENTITY = "proposal_id string, status string, award_status string, proposal_name string, program string, agency string, document_count long"


def given(spark):
    docs = spark.createDataFrame(ROWS, DOCUMENTS)
    return docs, spark.createDataFrame([(p, "s", "a", "n", "g", "y", 1) for p in "pqr"], IDENTITY)


@pytest.mark.parametrize("apart", [False, True])
def test_a_summary_is_made_of_chosen_texts(spark, apart):
    docs, identity = given(spark)
    told = docs.select("proposal_id", "ord", "summary_short")
    out = Y.proposal_summary(docs.drop("summary_short"), identity, "ord", told) if apart else Y.proposal_summary(docs, identity, "ord")
    assert {r.proposal_id: tuple(r)[1:] for r in out.collect()} == {
        "p": ("two", "three", ["two", "four"], "s (a)"), "q": ("kept", "kept", [], "s (a)"), "r": ("", "", [], "s (a)"),
    }
    assert sum("t" in names for names in inputs(out, {"Join"})) == 1


@pytest.mark.parametrize("apart", [False, True])
def test_a_folder_quotes_its_first_kept_documents(spark, apart):
    docs, identity = given(spark)
    many = spark.range(30).select(
        F.lit("q").alias("proposal_id"), F.format_string("x%02d", "id").alias("ord"), F.lit("supporting").alias("authority_rank"), F.lit("foa").alias("document_role"),
        (F.col("id") > 3).alias("include_in_clean_set"), F.concat(F.lit(" t"), "id").alias("summary_short"), F.concat(F.lit("n"), "id").alias("file_name_original"),
        F.lit(False).alias("manual_review_required"), F.lit(False).alias("sensitive"),
    )
    docs = docs.unionByName(many)
    told = docs.select("proposal_id", "ord", "file_name_original", "summary_short")
    out = K.folder_records(docs.drop("summary_short", "file_name_original"), identity, "ord", told) if apart else K.folder_records(docs, identity, "ord")
    got = {r.proposal_id: (r.summary_detailed, r.n_documents) for r in out.collect()}
    assert got == {"p": ("**c**: three\n\n**d**: four", 4), "q": ("**f**: kept\n\n**n4**: t4\n\n**n5**: t5\n\n**n6**: t6\n\n**n7**: t7", 32), "r": ("", 1)}
    assert not any({"summary_short", "t"} & names for names in inputs(out, {"Window"}))


def test_labels_are_joined_without_what_follows_from_ids(spark):
    joins = inputs(registry.documents(spark, SF).select("ord", "proposal_id", "file_name_original", "document_role", "agency", "h"), {"Join"})
    assert joins and not any({"scan_ord", "relative_path", "proposal_id", "file_name_original", "stem", "agency"} & names for names in joins)


def test_orders_outside_the_range_of_groups_are_not_shuffled(spark):
    plan = X.tracker(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"o_orderkey#\d+L >= 0\b", plan) and re.search(r"o_orderkey#\d+L <= \d+", plan)


def test_a_page_shuffles_places_for_orders_and_no_partners(spark):
    sent = inputs(registry.queries()["folder_page"](spark, SF), {"Aggregate", "Join", "Window"})
    assert sent and not any({"ord", "scan_ord", "partners"} & names for names in sent)


def test_an_identity_without_partners(spark):
    docs = registry.documents(spark, SF)
    found = lambda d: Y.canonical_identity(d, matched(spark, SF), "ord").drop("partners")
    assert sorted(map(str, found(docs.drop("partners")).collect())) == sorted(map(str, found(docs).collect()))
