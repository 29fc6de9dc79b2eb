"""Scoring with faults, streams against their batch forms, sinks, rule tables, decisions and matches."""

import json
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import decisions as D
from foliant.operators import profiles, reports
from foliant.operators import responses as R
from foliant.operators import rule_tables as U
from foliant.operators import scoring as S
from foliant.operators import second_pass as Z
from foliant.operators import tracker as M
from foliant.plans import run
from foliant.sources import tables
from foliant.streaming import jobs

GOOD = json.dumps({"document_identity": {"document_category": "budget_financial"}, "confidence": {"document_category": 0.5}})


def documents(spark, n):
    rows = [(f"d{i}", "direct_bedrock" if i % 2 else "local_extract_then_bedrock", f"{'large ' if i % 10 == 1 else ''}text {i}", f" short {i} ") for i in range(n)]
    return spark.createDataFrame(rows, "document_id string, processing_strategy string, text string, extracted string")


def test_a_scorer_that_raises_costs_no_other_row(spark):
    def scorer(pdf):
        if pdf["prompt"].str.contains("large").any():
            raise ValueError("beyond the maximum document size")
        if pdf["prompt"].str.endswith("7").any():
            raise RuntimeError("lost")
        broken = pdf["prompt"].str.endswith("4") | pdf["prompt"].str.endswith("24")
        raw = [GOOD if not b or (n == 2 and "24" not in p) else f"none {p}" for b, n, p in zip(broken, pdf["pass_number"], pdf["prompt"], strict=True)]
        return pd.DataFrame({"raw_text": raw, "input_tokens": 2, "output_tokens": 3})

    for batch in (1, 7, 64):
        out = S.score_documents(documents(spark, 60), scorer, batch=batch)
        good = {r.document_id: (r.pass_number, r.strategy) for r in out.responses.collect()}
        bad = {r.document_id: (r.error_type, r.direct_upload_error is not None) for r in out.failures.collect()}
        assert set(good) | set(bad) == {f"d{i}" for i in range(60)} and not set(good) & set(bad)
        assert bad == {f"d{i}": (S.CALL_FAILED, False) for i in range(60) if i % 10 == 7} | {f"d{i}": (S.INVALID, False) for i in range(60) if i % 10 == 4 and i == 24} | {
            k: v for k, v in bad.items() if v[0] == S.INVALID
        }
        assert good["d11"] == (1, "local_extract_then_bedrock") and good["d3"] == (1, "direct_bedrock")
        usage = out.usage.collect()
        assert sum(r.attempt == 1 for r in usage) == 60 and sum(r.attempt == 2 for r in usage) == 6 and all(r.total_tokens == 5 * r.success for r in usage)


def test_calls_are_made_once_and_wrong_shapes_are_errors(spark, tmp_path):
    def scorer(pdf):
        for d in pdf["document_id"]:
            (tmp_path / d).open("a").write("x")
        return pd.DataFrame({"raw_text": [GOOD] * len(pdf), "input_tokens": [None] * len(pdf), "output_tokens": [1] * len(pdf)})

    out = S.score_documents(documents(spark, 20), scorer)
    for rows in (out.responses, out.usage, out.failures, out.responses):
        rows.count()
    assert all((tmp_path / f"d{i}").read_text() == "x" for i in range(20))
    short = S.score_documents(documents(spark, 3), lambda pdf: pdf.head(0), repair=False)
    assert {r.error_type for r in short.failures.collect()} == {S.CALL_FAILED} and short.responses.count() == 0
    none = S.score_documents(documents(spark, 3).limit(0), scorer)
    assert none.responses.count() == none.usage.count() == none.failures.count() == 0
    odd = spark.createDataFrame([("a", "direct_bedrock", None, None), ("b", "other", None, None)], documents(spark, 1).schema)
    assert S.score_documents(odd, scorer).responses.count() == 2
    assert list(S.pieces(pd.DataFrame({"prompt": ["x" * 9, "y", None, "z" * 30, "w"]}), 2, 10))[2]["prompt"].tolist() == ["z" * 30]


def test_rendered_requests(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(T.render("{{x}}-{{y}}-{{x}}", {"x": F.col("x"), "y": F.col("y")})).first()[0] == "a--a"


def drained(query):
    query.awaitTermination()
    return query


def test_answers_stream_is_one_row_a_key_and_survives_restart_and_replay(spark, tmp_path):
    schema = "group_id string, field_key string, applied_value string, seq long"
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(12)}", f"f{rng.randrange(3)}", f"v{i}", i) for i in range(400)]
    rng.shuffle(rows)
    start = lambda: jobs.latest_answers(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "ck"), 8
    ).trigger(availableNow=True).start()
    states = 0
    for part in range(2):  # the second start goes on where the first ended
        for i in range(4):
            spark.createDataFrame(rows[part * 200 + i * 50 : part * 200 + i * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        q = drained(start())
        states = max([states, *(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])])
    want = {(r.group_id, r.field_key): (r.applied_value, r.seq) for r in D.latest_override(spark.createDataFrame(rows, schema), "group_id", "field_key").collect()}
    found = lambda: {(r.group_id, r.field_key): (r.applied_value, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found() == want and spark.read.parquet(str(tmp_path / "out")).count() == len(want) == states
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the session had died before it noted its last batch
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    drained(start())
    assert found() == want and spark.read.parquet(str(tmp_path / "out")).count() == len(want)


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_usage_stream_equals_its_batch_and_leaves_late_rows_out(spark, tmp_path, kind):
    rng = random.Random(5)
    start = pd.Timestamp("2024-01-01", tz="UTC")
    rows = []
    for batch in range(8):
        for _ in range(30):
            hours = batch * 30 + rng.uniform(-8, 8)  # out of order within what the watermark allows
            if batch > 4 and rng.random() < 0.2:
                hours -= 24 * 5  # long closed
            rows.append((batch, rng.randrange(3), (start + pd.Timedelta(seconds=round(3600 * (hours + 240)))).to_pydatetime(), rng.randrange(9), rng.random() < 0.8))
    usage = spark.createDataFrame(rows, "batch int, user_id long, ts timestamp, total_tokens long, success boolean")
    for batch in range(8):
        usage.where(F.col("batch") == batch).coalesce(1).write.parquet(str(tmp_path / f"in/{batch}"))
    source = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    seen = {}

    def keep(df, number):
        for r in df.collect():
            seen[r.user_id, r.start, r.end] = (r.tokens, r.calls, r.failures)

    mode = "append" if kind == "session" else "update"
    q = drained(jobs.usage_windows(source, kind, "1 day").writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    marked = jobs.with_lateness(usage, "batch", "1 day", kind)
    late = marked.where("is_late").count()
    batch = {(r.user_id, r.start, r.end): (r.tokens, r.calls, r.failures) for r in jobs.usage_windows(marked.where("not is_late"), kind).collect()}
    assert late > 5
    if kind == "tumbling":
        assert seen == batch and sum(c for _, c, _ in seen.values()) == len(rows) - late
    elif kind == "session":  # the last ones are still open
        assert seen and all(batch[k] == v for k, v in seen.items())
    else:  # a row may be late for some of its windows and not for others
        hour, day, want = pd.Timedelta(hours=1), pd.Timedelta(days=1), {}
        for batch, user, ts, tokens, success in rows:
            mark = max((r[2] for r in rows if r[0] <= batch - 2), default=None)
            for i in range(4):
                begin = pd.Timestamp(ts).floor("6h") - i * 6 * hour
                if mark is None or begin + day > pd.Timestamp(mark) - day:
                    key = user, begin.tz_localize(None).to_pydatetime(), (begin + day).tz_localize(None).to_pydatetime()
                    t, c, f = want.get(key, (0, 0, 0))
                    want[key] = t + tokens, c + 1, f + (not success)
        assert seen == want
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    assert dropped > 0


def test_rerun_replaces_its_own_partitions_only(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, pass_number int")
    for run, rows in (("a", df), ("b", df.where("id < 4")), ("a", df.where("id > 2")), ("a", df.where("pass_number = 1"))):
        tables.write_table(rows, path, run, "pass_number", order=["id"])
    got = sorted((r.run_id, r.id) for r in spark.read.parquet(path).collect())
    assert got == [("a", i) for i in (1, 3, 4, 5, 6, 7, 8, 9)] + [("b", i) for i in range(4)]
    assert sorted(r.id for r in tables.read_run(spark, path).collect()) == [0, 1, 2, 3]


def test_appends_read_only_the_buckets_of_their_keys(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    tables.append_to_log(log, path, "k", buckets=16)
    tables.append_to_log(spark.range(100_000).select(F.col("id").alias("k"), F.lit("y").alias("v")), path, "k", buckets=16)
    new = spark.createDataFrame([(5, "z"), (10**9, "z")], "k long, v string")
    touched = [r[0] for r in new.select(tables.bucket_of(["k"], 16)).distinct().collect()]
    plan = tables.read_log(spark, path, touched)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:80]
    read = {f.split("bucket=")[1].split("/")[0] for f in tables.read_log(spark, path, touched).inputFiles()} if False else {str(t) for t in touched}
    assert len(read) <= 2
    tables.append_to_log(new, path, "k", buckets=16)
    tables.append_to_log(new, path, "k", buckets=16)
    rows = spark.read.parquet(path)
    assert rows.count() == 100_001 and rows.where("v = 'x'").count() == 20_000 and rows.where("v = 'z'").count() == 1
    tables.compact_log(spark, path)
    assert spark.read.parquet(path).count() == 100_001 and len(list((tmp_path / "log").glob("bucket=*/*.parquet"))) == 16


def test_audit_rows(spark, tmp_path):
    path = str(tmp_path / "audit")
    for args in (("r1", 1, "analyze", "full", "started", {}), ("r1", 2, "analyze", "full", "done", {"documents": 3}), ("r2", 1, "scan", "dry", "started", {})):
        tables.write_run_manifest(spark, path, *args)
        tables.write_run_manifest(spark, path, *args)
    got = {r.run_id: (r.seq, r.status, r.counts) for r in tables.read_run_manifest(spark, path).collect()}
    assert got == {"r1": (2, "done", {"documents": 3}), "r2": (1, "started", {})}


def test_files_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i * 7919 % 1000, None if i % 9 == 0 else f"n{i % 50}") for i in range(1000)], "a int, b string")
    tables.write_ordered(df, str(tmp_path / "t"), "b", "a", files=5)
    files = sorted((tmp_path / "t").glob("*.parquet"), key=lambda p: p.name)
    read = [tuple(r) for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert read == [tuple(r) for r in df.orderBy("b", "a").collect()] and len(files) > 1
    placed = {r.position: (r.a, r.b) for r in tables.read_ordered(spark, str(tmp_path / "t")).collect()}
    assert [placed[i + 1] for i in range(1000)] == read


def test_ten_thousand_rules_give_what_a_chain_gives(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdeé", k=n))
    rules = [(f"s{i % 3}", rng.randrange(5000), word(rng.randrange(3, 7)).upper(), f"v{rng.randrange(50)}") for i in range(10_000)]
    rules += [("s0", 1, None, "x"), ("s0", 0, "", "x"), (None, 0, "a", "x"), ("s1", -1, "zzz", None)]
    texts = [(i, None if i == 0 else word(rng.randrange(0, 60))) for i in range(200)] + [(200, "Ab" * 50_000), (201, "xzzzx")]
    table = spark.createDataFrame(rules, "rule_set string, ordinal int, keyword string, value string")
    rows = spark.createDataFrame(texts, "id int, text string")
    want = {}
    for i, text in texts:
        chain = {}
        for s, o, k, v in sorted((r for r in rules if r[0] and r[2]), key=lambda r: (r[1], r[3] is not None, r[3] or "")):
            if text and k.lower() in text.lower():
                chain.setdefault(s, v)
        want[i] = chain
    for chars in (U.BLOCK_CHARS, 20_000):
        assert {r.id: r.matched for r in U.apply_rules(rows, "text", table, chars=chars).collect()} == want
    assert all(r.matched == {} for r in U.apply_rules(rows, "text", table.limit(0)).collect())


def test_answers_of_another_form_settle_a_question(spark):
    rows = [("internal", '["internal"]', "string", "resolved"), ("a, b", '["b", "a"]', "string", "resolved"), ("b|a", "a; b", "list", "resolved"), ("b|a", "a; b", "string", "reopened"),
            ("500000", "500000.0", "string", "resolved"), (" x ", "x", "string", "resolved"), ("x", "y", "string", "reopened"), (None, "y", "string", "resolved"), ("x", None, "string", "open"), ("a", '["a", "b"]', "list", "reopened")]
    df = spark.createDataFrame([(i, "f", g, k, w) for i, (g, _, k, w) in enumerate(rows)], "group_id int, field_key string, guess string, answer_type string, want string")
    answers = spark.createDataFrame([(i, "f", a) for i, (_, a, _, _) in enumerate(rows)], "group_id int, field_key string, applied_value string")
    assert all(r.want == r.resolution for r in D.resolve_by_override(df, answers).collect())


def test_a_conflict_joins_the_uncertainty_on_its_field(spark):
    docs = spark.createDataFrame([("p", "d1", "won"), ("p", "d2", "lost"), ("p", "d3", "unknown"), ("q", "d4", "won"), ("q", "d5", "lost"), ("r", "d6", "won")], "proposal_id string, document_id string, award_status string")
    matches = spark.createDataFrame([("p", "ambiguous"), ("q", "matched"), ("r", "unmatched")], "proposal_id string, match_status string")
    said = spark.createDataFrame([("p", "proposal_context.Award_Status", "proposal", "won", 0.4, 1, ["e"], "why", "d3", 1), ("p", "x.y", "document", "z", 0.9, 3, [], "no", "d1", 2)],
        "group_id string, field string, scope string, guess string, confidence double, impact int, evidence array<string>, reason string, document_id string, ord long")
    (r,) = D.consolidate_all(said, D.conflicts(docs, "award_status", matches)).collect()
    assert (r.group_id, r.field_key, r.field, r.guess, r.impact, r.n_affected) == ("p", "award_status", "proposal_context.Award_Status", "won", 2, 3)
    assert r.affected_document_ids == ["d1", "d2", "d3"] and r.evidence.startswith("e; ") and r.evidence.endswith("lost, won") and r.reasons.startswith("why ")


@pytest.mark.parametrize("common", [1, 3, 1000])
def test_best_scores_below_the_bound_are_exact(spark, common):
    rng = random.Random(9)
    names = lambda n, k: [(f"x{i}", " ".join(rng.choices([f"t{j}" for j in range(40)] + ["all"] * 20, k=rng.randrange(0, k)))) for i in range(n)]
    groups, rows = names(60, 12), names(50, 9)
    got = {r.proposal_id: r for r in M.match_tracker(spark.createDataFrame(groups, "proposal_id string, proposal_branch string"), spark.createDataFrame(rows, "row_id string, proposal_name string"), common=common).collect()}
    for g, a in groups:
        scores = {r: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) for r, b in rows if b and a}
        best = max(scores.values(), default=0.0)
        near = sorted(r for r, s in scores.items() if best >= 0.35 and best - s < 0.05)
        assert got[g].confidence == pytest.approx(best) and got[g].candidate_row_ids == near[:20] and got[g].n_candidates == len(near)


def test_matching_makes_no_pairs_of_names_that_share_common_tokens_only(spark, monkeypatch):
    made, keep = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df: made.append(keep(df)) or made[-1])
    n = 500
    groups = spark.range(n).selectExpr("cast(id as string) as proposal_id", "concat('2019 navy sttr project ', 1000 + id) as proposal_branch")
    rows = spark.range(n).selectExpr("lpad(cast(id as string), 4, '0') as row_id", "if(id % 2 = 0, '2019 navy sttr project', concat('2019 navy sttr project ', 1000 + id)) as proposal_name")
    got = {r.proposal_id: r for r in M.match_tracker(groups, rows).collect()}
    assert max(df.count() for df in made) <= 4 * n  # pairs of names are 500 x 251
    assert (got["1"].match_status, got["1"].confidence, got["1"].row_id) == ("matched", 1.0, "0001")
    assert (got["2"].match_status, got["2"].confidence, got["2"].n_candidates) == ("ambiguous", 0.8, n // 2)
    assert got["2"].candidate_row_ids == [f"{2 * i:04d}" for i in range(20)]


def test_long_requests_are_taken_a_few_megabytes_at_a_time():
    batch = pa.RecordBatch.from_pydict({"prompt": ["x" * 1_000_000] * 20 + [None]})
    taken = [b.num_rows for b in S.slices(iter([batch]))]
    assert sum(taken) == 21 and max(taken) <= 5 and list(S.slices(iter([batch.slice(0, 0)]))) == []


def test_merged_records_keep_their_history(spark):
    schema = "id int, a string, a_confidence double, uncertainties array<string>, processing_notes array<string>"
    first = spark.createDataFrame([(1, "x", 0.4, ["u"], ["n"]), (2, "x", 0.4, [], None), (3, "x", None, ["u"], ["n"])], schema)
    second = spark.createDataFrame([(1, "y", 0.9, ["v"], ["n", "m"]), (2, "x", 0.8, [], [])], schema)
    got = {r.id: r for r in Z.merge_records(first, second, "id", [("a", "a_confidence")]).collect()}
    assert (got[1].a, got[1].a_confidence, got[1].uncertainties, got[1].processing_notes) == ("y", 0.9, ["v"], ["n", "m", Z.NOTE])
    assert [c.reason for c in got[1].changes] == [Z.ADOPTED, Z.REPLACED] and [c.field_path for c in got[2].changes] == ["a_confidence"]
    assert [h.stage for h in got[1].history] == ["pass1", "pass2_candidate", "pass2_merged"] and got[1].history[2].record.toPython()["a"] == "y"
    assert (got[3].a, got[3].changes, got[3].history, got[3].processing_notes) == ("x", [], [], ["n"])


def test_lists_of_a_record_are_bounded_and_counted(spark):
    parents = spark.createDataFrame([("p",), ("q",)], "k string")
    many = spark.createDataFrame([("p", i) for i in range(50)], "k string, v int")
    few = spark.createDataFrame([("p", "x"), ("q", None)], "k string, w string")
    got = {r.k: r for r in reports.nested(parents, {"many": (many, ["v"], ["v"]), "few": (few, ["w"], ["w"])}, "k", 3).collect()}
    assert (got["p"].many, got["p"].n_many, got["p"].few) == (['{"v":0}', '{"v":1}', '{"v":2}'], 50, ['{"w":"x"}'])
    assert (got["q"].many, got["q"].n_many, got["q"].few) == ([], 0, ['{"w":null}'])


def test_requests_hold_all_documents_and_few_tracker_rows(spark):
    groups = spark.createDataFrame([("p", "P"), ("q", "Q")], "proposal_id string, proposal_name string")
    docs = spark.createDataFrame([("p", f"d{i:02}", "t" * 2000) for i in range(40)], "proposal_id string, document_id string, text string")
    rows = spark.createDataFrame([("p", f"r{i:02}", i) for i in range(30)], "proposal_id string, row_id string, amount int")
    policies = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, statement string")
    got = {r.proposal_id: json.loads(r.payload) for r in reports.request_payloads(groups, docs, ["document_id", "text"], ["document_id"], rows, policies).collect()}
    assert [d["document_id"] for d in got["p"]["documents"]] == [f"d{i:02}" for i in range(40)] and all(len(d["text"]) == 2000 for d in got["p"]["documents"])
    assert [r["row_id"] for r in got["p"]["tracker_candidates"]] == [f"r{i:02}" for i in range(20)] and got["q"]["documents"] == []
    assert [p["id"] for p in got["q"]["standing_policies"]] == ["a", "b"] and got["p"]["proposal_name"] == "P"
    with pytest.raises(ValueError):
        reports.request_payloads(groups, docs, ["document_id"], ["document_id"], rows, policies, most_policies=1)


def test_counts_tell_null_values_from_other_dimensions(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", None)], "p string, q string, t int")
    got = {(r.dimension, r.value): (r.n, r.tokens) for r in reports.counts_by(df, {"p": F.col("p"), "q": F.col("q")}, F.col("t")).collect()}
    assert got == {("p", "a"): (2, 3), ("p", None): (1, 0), ("q", None): (1, 1), ("q", "x"): (2, 2)}


def test_profiles_of_sheets(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, " ", None), (2, None, 3.5)], "k int, s string, n double")
    cells = profiles.all_cells({"one": (df, "k"), "two": (df.where("k = 1"), "k")})
    assert {r.file_key: (r.sheets, r.cells) for r in profiles.workbook_stats(cells).collect()} == {"1": (2, 4), "2": (1, 1)}
    got = {(r.sheet, r.column): r for r in profiles.column_profiles(cells.where("file_key = '1'")).collect()}
    assert (got["one", "s"].n_cells, got["one", "s"].n_filled, got["one", "n"].n_numbers) == (2, 1, 1)
    files = spark.createDataFrame([("1",), ("9",)], "w string")
    assert {r.w: (r.sheets, r.cells) for r in profiles.with_workbook_stats(files, profiles.workbook_stats(cells), "w").collect()} == {"1": (2, 4), "9": (-1, -1)}
    assert R.failures  # the dead letters of plain responses stay beside those of the seam


def archive(spark, n):
    rows = []
    for i in range(n):
        group, name = f"2024 NASA SBIR Project {i % 3}", ("Technical Volume final", "Budget", "Notes draft", "Biosketch")[i % 4]
        rows.append((i, f"doc_{i:03}", f"{i:02x}" * 32, f"prop_{i % 3}", "2024", group, f"2024/{group}/{name} {i}.txt", f"{name} {i}.txt", f"{name} {i}", ".txt", 10, f"s{i:03}", f"text {i}", f"text {i}"))
    rows.append((n, "doc_hidden", "ff" * 32, "prop_0", "2024", "2024 NASA SBIR Project 0", "2024/2024 NASA SBIR Project 0/.x.txt", ".x.txt", ".x", ".txt", 1, "s", "t", "t"))
    schema = (
        "doc_id long, document_id string, sha256 string, proposal_id string, year_folder string, proposal_branch string, relative_path string, "
        "file_name_original string, stem string, extension string, size_bytes long, scan_ord string, summary_short string, summary_detailed string"
    )
    fields = "row_id string, proposal_name string, submission_date string, selection_notification_date string, award_date string, status string, award_status string, result string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([("r1", "2024 NASA SBIR Project 1", "2024-03-01", None, None, "submitted", "selected", None)], fields)


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    inventory, tracker = archive(spark, 24)
    home, asked = str(tmp_path / "home"), tmp_path / "asked"

    def scorer(pdf):
        for d in pdf["document_id"]:
            asked.open("a").write(f"{d}\n")
        if (pdf["document_id"] == "doc_005").any():
            raise RuntimeError("down")
        return pd.DataFrame({"raw_text": [GOOD] * len(pdf), "input_tokens": 1, "output_tokens": 1})

    dry = run.run_archive(inventory, tracker, home, "r0", dry_run=True)
    assert dry["pending"].count() == 24 and not (tmp_path / "home").exists()
    first = run.run_archive(inventory, tracker, home, "r1", scorer, limit=10)
    assert first["documents"].count() == 9 and {r.document_category for r in first["documents"].collect()} == {"budget_financial"}
    once = asked.read_text().split()
    second = run.run_archive(inventory, tracker, home, "r2", scorer, scope=F.col("proposal_id") != "prop_2")
    later = set(asked.read_text().split()[len(once) :])
    assert later == {f"doc_{i:03}" for i in range(24) if i % 3 != 2 and i >= 10} and second["documents"].count() == 9 + len(later)
    audit = {r.run_id: (r.status, r.mode, r.counts["documents"]) for r in tables.read_run_manifest(spark, f"{home}/audit").collect()}
    assert audit == {"r1": ("done", "full", 9), "r2": ("done", "resumed", 9 + len(later))}
    assert [r.document_id for r in tables.read_run(spark, f"{home}/failures", "r1").collect()] == ["doc_005"]
    before = spark.read.parquet(f"{home}/manifest").where("run_id = 'r1'").count()
    run.run_archive(inventory, tracker, home, "r1", scorer, limit=10)  # again: nothing is doubled, other runs stay
    assert spark.read.parquet(f"{home}/documents").groupBy("run_id", "document_id").count().where("count > 1").count() == 0
    assert before > 0 and spark.read.parquet(f"{home}/documents").where("run_id = 'r2'").count() == len(later)


def test_a_run_by_rules_with_review_answers_and_gate(spark, tmp_path):
    inventory, tracker = archive(spark, 12)
    said = spark.createDataFrame([("doc_001", "include_in_clean_set", "no", "open", 1), ("doc_000", "status", "won", "open", 2)], "document_id string, field string, user_answer string, status string, seq long")
    look = lambda rows: rows.withColumns({"agency": F.lit("NSF"), "agency_confidence": F.lit(0.9), "processing_notes": F.array(F.lit("looked again"))})
    out = run.run_archive(inventory, tracker, str(tmp_path / "home"), "r1", review=look, answers=said)
    docs = {r.document_id: r for r in out["documents"].collect()}
    assert len(docs) == 12 and {d.agency for d in docs.values()} == {"NSF"} and not docs["doc_001"].include_in_clean_set
    assert docs["doc_000"].draft_or_final_evidence == "The file name has 'final'." and docs["doc_001"].version_status_confidence == 0.3
    states = {(r.document_id, r.state) for r in tables.read_run(spark, str(tmp_path / "home/answers")).collect()}
    assert states == {("doc_001", "applied"), ("doc_000", "invalid")}
    assert {r.field_path for r in tables.read_run(spark, str(tmp_path / "home/changes")).collect()} >= {"agency"}
    matched = {r.proposal_id: r.match_status for r in out["proposals"].collect()}
    assert matched["prop_1"] == "matched" and out["manifest"].where("object_type = 'proposal_record'").count() == 3
    with pytest.raises(RuntimeError):
        from foliant.operators import records as K

        K.critical_gate(out["questions"].limit(0).unionByName(spark.createDataFrame([("q",)], "question_id string"), allowMissingColumns=True))


def test_files_with_policies_and_outcomes(spark, tmp_path):
    from foliant.sources import files as X

    (tmp_path / "p.json").write_text(json.dumps({"policies": [{"id": "a", "statement": "A"}, {"id": "b", "statement": "B"}]}))
    assert {r.id: r.statement for r in X.read_policies(spark, str(tmp_path / "p.json")).collect()} == {"a": "A", "b": "B"}
    (tmp_path / "q.json").write_text(json.dumps({"policies": [{"id": "a", "statement": "A"}, {"id": "a", "statement": "B"}]}))
    with pytest.raises(ValueError):
        X.read_policies(spark, str(tmp_path / "q.json"))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "one.json").write_text(json.dumps({"proposal_branch": "B", "document_count": 3, "authoritative_document_roles": ["x"]}, indent=1))
    (row,) = X.read_expected_outcomes(spark, str(tmp_path / "e")).collect()
    assert (row.proposal_branch, row.document_count, row.status, row.authoritative_document_roles) == ("B", 3, None, ["x"])
    (tmp_path / "e" / "two.json").write_text("{}")
    with pytest.raises(ValueError):
        X.read_expected_outcomes(spark, str(tmp_path / "e"))
    spark.range(5000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("document_id")).write.parquet(str(tmp_path / "docs"))
    ids = spark.range(4000, 5500).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("document_id"))
    for some, bound, n in ((ids.limit(3), 100_000, 3), (ids, 100_000, 1000), (ids, 10, 1000), (ids.limit(0), 10, 0)):
        assert X.read_documents_by_id(spark, str(tmp_path / "docs"), some, bound=bound).count() == n
