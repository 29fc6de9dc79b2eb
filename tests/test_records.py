from foliant.operators import answers as N
from foliant.operators import identity as Y
from foliant.operators import records as K
from foliant.operators import responses as R
from foliant.plans import run

import pytest
from pyspark.sql import functions as F


def test_answers_are_checked_by_what_their_field_takes(spark):
    rows = [("agency", "NASA", "open"), ("agency", "Nasa", "open"), ("include_in_clean_set", "Y", None), ("include_in_clean_set", "si", "open"), ("award_amount", "1e3", "open"),
            ("award_amount", "much", "open"), ("partners", '["a", "b"]', "open"), ("partners", "a| b,,c", "open"), ("secret", "x", "open"), ("agency", " ", "open"), ("agency", "NASA", "Applied"), (None, "x", "open")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, field string, user_answer string, status string")
    got = {r.i: (r.state, r.value) for r in N.with_values(df).collect()}
    assert got == {0: ("valid", "NASA"), 1: ("invalid", None), 2: ("valid", "true"), 3: ("invalid", None), 4: ("valid", "1000.0"), 5: ("invalid", None),
                   6: ("valid", "a|b"), 7: ("valid", "a|b|c"), 8: ("invalid", None), 9: ("skipped", None), 10: ("skipped", None), 11: ("invalid", None)}


def test_nested_paths(spark):
    df = spark.createDataFrame([(1, ("a", "b"))], "i int, r struct<x:string,y:string>")
    assert N.set_path(df, "r.y", F.lit("c")).select(N.get_path("r.y")).first()[0] == "c"


def test_a_chosen_document_leads_and_excluded_ones_stay_out(spark):
    rows = [("p", "a", "authoritative", None), ("p", "b", "supporting", "a"), ("p", "c", "excluded", None), ("q", "a", "authoritative", None)]
    lineage = spark.createDataFrame(rows, "proposal_id string, document_id string, authority_rank string, superseded_by_document_id string")
    choices = spark.createDataFrame([("p", "a", ["a", "b", "c"], 1), ("p", "b", ["a", "b", "c"], 2)], "proposal_id string, chosen string, affected_document_ids array<string>, seq int")
    got = {tuple(r) for r in N.choose_authoritative(lineage, choices).collect()}
    assert got == {("p", "a", "supporting", "b"), ("p", "b", "authoritative", None), ("p", "c", "excluded", None), ("q", "a", "authoritative", None)}


def test_a_tracker_without_a_match_changes_nothing(spark):
    own = spark.createDataFrame([("p", "Own", None, "unknown", "unknown"), ("q", "Own", "2024-01-01", "drafted", "unknown")], "proposal_id string, proposal_name string, submission_date string, status string, award_status string")
    fields = "row_id string, proposal_name string, submission_date string, selection_notification_date string, award_date string, status string, award_status string, result string"
    rows = spark.createDataFrame([("r", "Theirs", "2024-02-02", None, None, "Pre-Submission!", "", "won"), ("s", None, None, None, None, "no such", None, None)], fields)
    matches = spark.createDataFrame([("p", "unmatched", 0.0, None), ("q", "matched", 1.0, "r")], "proposal_id string, match_status string, confidence double, row_id string")
    got = {r.proposal_id: r for r in Y.override_identity(own, Y.matched_rows(matches, rows)).collect()}
    assert (got["p"].proposal_name, got["p"].match_status, got["p"].disagreements) == ("Own", "unmatched", [])
    assert (got["q"].proposal_name, got["q"].submission_date, got["q"].status, got["q"].award_status) == ("Theirs", "2024-02-02", "drafted", "won")
    assert [d.field for d in got["q"].disagreements] == ["canonical_proposal_name", "submission_date", "award_status"]


def test_the_gate_stops_at_one_open_question(spark):
    questions = spark.createDataFrame([("q1",)], "question_id string")
    with pytest.raises(RuntimeError, match="q1"):
        K.critical_gate(questions)
    K.critical_gate(questions, allow_open=True)
    K.critical_gate(questions.limit(0))


def test_a_record_with_other_or_missing_fields_is_reported(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 1, "c": 2}',), ('{"b": 1}',)], "body string")
    got = [r.violations for r in R.with_violations(df, R.closed_record(F.col("body"), ("a", "b"), ("a",))).collect()]
    assert got == [[], ["closed"], ["required"]]


def test_a_whole_run_over_two_groups(spark):
    """One group with a final, a draft, a budget, an award notice and a copied letter; one with a personal biosketch."""
    files = [("A SBIR Battery", n) for n in ("Technical Volume FINAL.pdf", "Technical Volume DRAFT.pdf", "Reviewer Feedback.pdf", "Award Notice.pdf", "Budget.xlsx", "Support Letter.pdf", "Copy/Support Letter.pdf")]
    files += [("B Solo", "Project Description FINAL.pdf"), ("B Solo", "Team Biosketch.pdf")]
    rows, details = [], []
    for i, (group, name) in enumerate(files):
        path, stem = f"2025/{group}/{name}", name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        sha = ("letter" if "Letter" in stem else f"{i}").ljust(64, "0")
        rows.append((i, f"doc_{sha[:16]}", f"prop_{group}", "2025", group, path, name.rsplit("/", 1)[-1], stem, "." + name.rsplit(".", 1)[-1], path.lower(), sha, 10))
        personal = "Biosketch" in name
        details.append((i, f"text {i}", f"text {i}", True, True, None, personal, ["personal"] if personal else [], "unknown", "awarded" if "Award" in name else "unknown", "unknown", None, None, ["Partner"], 0.5))
    inventory = spark.createDataFrame(rows, "doc_id long, document_id string, proposal_id string, year_folder string, proposal_branch string, relative_path string, file_name_original string, stem string, extension string, scan_ord string, sha256 string, size_bytes long")
    detail = spark.createDataFrame(details, "doc_id long, summary_short string, summary_detailed string, include_in_clean_set boolean, include_in_future_rag boolean, exclude_reason string, manual_review_required boolean, manual_review_reasons array<string>, canonical_proposal_name string, status string, award_status string, submission_date string, lead_organization string, partners array<string>, name_confidence double")
    tracker = spark.createDataFrame([("r1", "SBIR Battery", None, None, None, "active", None, None)], "row_id string, proposal_name string, submission_date string, selection_notification_date string, award_date string, status string, award_status string, result string")
    out = run.run_all(inventory, detail, tracker)
    assert out["documents"].groupBy("proposal_branch").count().orderBy("proposal_branch").collect() == [("A SBIR Battery", 6), ("B Solo", 2)]
    lineage = {r.stem: (r.authority_rank, r.recommended_treatment) for r in out["lineage"].collect()}
    assert {k for k, v in lineage.items() if v[0] == "authoritative"} == {"Technical Volume FINAL", "Project Description FINAL"}
    assert {k for k, v in lineage.items() if v[1] == "exclude"} == {"Budget", "Team Biosketch"}
    proposals = {r.proposal_branch: r for r in out["proposals"].collect()}
    assert (proposals["A SBIR Battery"].status, proposals["A SBIR Battery"].proposal_name, proposals["B Solo"].match_status) == ("active", "SBIR Battery", "unmatched")
    assert {r.exclusion_reason for r in out["exclusions"].collect()} == {"manual_review_required: personal"} and out["plan"].count() == 7
    with pytest.raises(RuntimeError):
        run.run_all(inventory, detail, tracker, questions=spark.createDataFrame([("q",)], "question_id string"))


def test_new_documents_stream_gives_each_content_once(spark, tmp_path):
    from foliant.streaming import jobs

    schema = "document_id string, path string, modified_time timestamp"
    rows = [("d1", "a", "2025-01-01 00:00:00"), ("d1", "b", "2025-01-01 01:00:00"), ("d2", "c", "2025-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "document_id string, path string, t string").select("document_id", "path", F.col("t").cast("timestamp").alias("modified_time"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.new_documents(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("fresh_documents").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.document_id for r in spark.table("fresh_documents").collect()) == ["d1", "d2"]


def test_answers_that_leave_no_reason_are_passed_over_one_by_one(spark):
    docs = spark.createDataFrame([("a", True, True, "why", None), ("b", False, False, None, "not"), ("c", True, False, "why", "not")],
        "document_id string, include_in_clean_set boolean, include_in_future_rag boolean, include_reason string, exclude_reason string")
    rows = [("a", "include_in_clean_set", "no", 1), ("a", "include_in_future_rag", "no", 2), ("a", "include_in_clean_set", "yes", 3), ("b", "include_in_clean_set", "yes", 4),
            ("b", "include_in_future_rag", "no", 5), ("c", "include_in_clean_set", "no", 6), ("d", "needs_powerpoint_processing", "yes", 7), ("a", "needs_powerpoint_processing", "yes", 8)]
    answers = spark.createDataFrame([("q", d, f, a, "open", s) for d, f, a, s in rows], "question_id string, document_id string, field string, user_answer string, status string, seq long")
    out, judged, decks = N.apply_reviewed_answers(docs, answers)
    assert {r.seq: r.state for r in judged.collect()} == {1: "applied", 2: "invalid", 3: "applied", 4: "invalid", 5: "applied", 6: "applied", 7: "applied", 8: "invalid"}
    assert {r.document_id: (r.include_in_clean_set, r.include_in_future_rag) for r in out.collect()} == {"a": (True, True), "b": (False, False), "c": (False, False)}
    assert [(r.document_id, r.needs_processing) for r in decks.collect()] == [("d", True)]
