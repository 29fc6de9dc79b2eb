import json

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from foliant.functions import text as T
from foliant.operators import clean_set as S
from foliant.operators import responses as R
from foliant.operators import second_pass as P
from foliant.sources import files as X
from foliant.sources import tables


def test_responses_of_every_shape(spark):
    raw = ['{"a": 1}', '```json\n{"a": 2}\n```', '[{"a": 3}]', 'so { it is {"a": 4} }', '{"a": {"b": 5}', "no", "", None, "{" * 50]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw_text string")
    strict = {r.i: r.body for r in R.parse_strict(df).collect()}
    assert {i for i, b in strict.items() if b} == {0, 1}
    got = {r.i: json.loads(r.body) for r in R.parse_lenient(df).where("body is not null").collect()}
    assert got == {0: {"a": 1}, 1: {"a": 2}, 2: {"a": 3}, 3: {"a": 4}, 4: {"b": 5}}
    assert R.parse_lenient(df.limit(0)).count() == 0


def test_a_null_check_is_a_violation_and_no_row_is_lost(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "i int, confidence double")
    good, bad = R.validate(df, {"confidence": F.col("confidence").between(0, 1)})
    assert [r.i for r in good.collect()] == [1] and sorted(r.i for r in bad.collect()) == [2, 3]


def test_what_a_second_pass_may_replace(spark):
    rows = [
        ("unknown", 0.1, "x", 0.8, False, True), ("unknown", 0.1, "x", 0.5, True, False), ("a", 0.9, "x", 0.95, False, False),
        ("a", 0.9, "x", 0.95, True, True), ("a", 0.9, "x", 0.9, True, False), ("a", 0.3, "x", 0.4, False, True),
        ("a", 0.3, " Unknown ", 0.9, True, False), ("a", 0.3, None, 0.9, True, False), (None, 0.0, "x", 0.75, False, True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, o string, oc double, n string, nc double, e boolean, w boolean")
    take = P.adopt(F.col("o"), F.col("n"), F.col("oc"), F.col("nc"), 0.75, F.col("e"))
    assert [r.i for r in df.withColumn("t", take).where("not (t <=> w)").collect()] == []


def test_merge_keeps_rows_without_a_second_look(spark):
    first = spark.createDataFrame([(1, "a", 0.2), (2, "b", 0.2), (3, "c", 0.2)], "i int, v string, c double")
    second = spark.createDataFrame([(1, "x", 0.9, False, "r"), (2, "b", 0.7, False, "r")], "i int, v string, c double, explained boolean, reason string")
    out = P.merge_passes(first, second, "i", [("v", "c")])
    assert {r.i: (r.v, r.c, len(r.changes)) for r in out.collect()} == {1: ("x", 0.9, 1), 2: ("b", 0.7, 0), 3: ("c", 0.2, 0)}
    log = P.change_log(out, "i").collect()
    assert [(r.i, r.old_value, r.new_value, r.old_confidence, r.new_confidence) for r in log] == [(1, "a", "x", "0.20", "0.90")]


def test_branch_signals_leave_out_the_own_vote(spark):
    rows = [(1, "g", "z"), (2, "g", "b"), (3, "g", "b"), (4, "g", None), (5, "h", "a"), (6, "k", "x"), (7, "k", "c"), (8, "k", "x"), (9, "k", "c")]
    df = spark.createDataFrame(rows, "i int, proposal_id string, v string")
    # ties go to the value seen first among the others
    assert {r.i: r.suggested for r in P.branch_signals(df, "v", "i").collect()} == {1: "b", 2: "z", 3: "z", 4: "b", 5: None, 6: "c", 7: "x", 8: "c", 9: "x"}


def test_context_is_what_lies_beside_the_target(spark):
    rows = [("g", i, s) for i, s in ((1, 0.9), (2, 0.75), (3, 0.1))] + [("h", 10 + i, i / 10) for i in range(8)] + [("k", 20, 0.8), ("k", 21, 0.2)]
    df = spark.createDataFrame([(g, i, f"d{i:03}", str(i), s, 0.0) for g, i, s in rows], "proposal_id string, doc_id long, document_id string, scan_ord string, category_confidence double, role_confidence double")
    got = {(r.proposal_id, r.target, r.neighbour) for r in P.context_neighbours(df).collect()}
    assert {x for x in got if x[0] == "g"} == {("g", None, 1), ("g", None, 2)} and {x for x in got if x[0] == "k"} == {("k", None, 20), ("k", 20, 21)}
    assert {x[2] for x in got if x[:2] == ("h", 17)} == {16, 15, 14, 13, 12} and {x[2] for x in got if x[:2] == ("h", 10)} == {17, 16, 15, 14, 13}


def test_no_two_files_get_one_name(spark):
    from foliant.operators import inventory as I

    names = ["a.txt", "a.txt", "a__22222222_2.txt", "a.txt", "a__22222222.txt", "a.txt", "b", "b", "A.txt"]
    df = spark.createDataFrame([("p", n, "2" * 64, f"{i:03}", i) for i, n in enumerate(names)], "proposal_id string, file_name_original string, sha256 string, scan_ord string, i int")
    got = {r.i: r.target_name for r in I.resolve_name_collisions(df).collect()}
    assert got == {0: "a.txt", 1: "a__22222222_3.txt", 2: "a__22222222_2.txt", 3: "a__22222222_4.txt", 4: "a__22222222.txt", 5: "a__22222222_5.txt", 6: "b", 7: "b__22222222", 8: "A.txt"}


def test_hostile_responses_take_no_time(spark):
    import time

    raw = ['{"a":' * 100_000, "{" * 80_000, '{"' * 80_000, '{"a":' * 20_000 + "}" * 20_000, "x {{ {\"k\": {\"l\": 1}} y"]
    raw += ['{"a{"a' * 40_000, '{"a":1 ' * 3000 + '{"b": 2}', '{"a":"{ "' * 20_000]
    began = time.time()
    got = [r.body for r in R.parse_lenient(spark.createDataFrame(list(enumerate(raw)), "i int, raw_text string").repartition(1)).orderBy("i").collect()]
    assert got[:4] == [None] * 4 and json.loads(got[4]) == {"k": {"l": 1}} and time.time() - began < 60
    assert got[5:] == [None, '{"b": 2}', None]


def test_first_object_is_that_of_trying_every_brace():
    import random

    import pandas as pd

    def plain(text):
        for at in (i for i, c in enumerate(text) if c == "{"):
            try:
                return json.dumps(json.JSONDecoder().raw_decode(text, at)[0])
            except ValueError:
                continue
        return None

    parts = ["{", "}", '"', '"a"', ":", "1", ",", "[", "]", "\\", '{"a":', "{}", " ", "x", "\n"]
    dice = random.Random(3)
    texts = ["".join(dice.choices(parts, k=dice.randint(1, 200 if i % 10 == 0 else 24))) for i in range(20_000)]
    assert R.first_object.func(pd.Series(texts)).tolist() == [plain(t) for t in texts]


def test_conflicts_need_two_known_values(spark):
    df = spark.createDataFrame([("g", "won"), ("g", "lost"), ("g", "unknown"), ("h", "won"), ("h", "won"), ("h", None)], "proposal_id string, v string")
    assert [tuple(r) for r in S.detect_conflict(df, "v").collect()] == [("g", "lost, won", 2)]


def test_text_for_requests_and_errors(spark):
    df = spark.createDataFrame([("  abcdef ",), ("abc",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.request_text(F.col("t"), 4)).collect()] == ["[Cut from 6 to 4 characters]\n\nabcd", "abc", "(no text)", "(no text)"]
    df = spark.createDataFrame([("ThrottlingException: too many TOKENS PER DAY",), ("ThrottlingException: slow",), ("tokens per day",), (None,)], "m string")
    assert [r[0] for r in df.select(T.quota_error(F.col("m"))).collect()] == [True, False, False, False]
    df = spark.createDataFrame([("a_b (1).v2.pdf",), (".x",), ("??.txt",), (None,)], "f string")
    assert [r[0] for r in df.select(T.safe_doc_title(F.col("f"))).collect()] == ["a b (1) v2", "x", "document", "document"]


def test_jsonl_and_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', None), (2, "", 0.5)], "z int, a string, m double")
    X.write_jsonl(df, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert list(json.loads(lines[0])) == ["a", "m", "z"]
    (tmp_path / "j" / "more.txt").write_text('\n{"z": broken\n')
    good, bad = X.read_jsonl(spark, str(tmp_path / "j"), df.schema)
    assert sorted(tuple(r) for r in good.collect()) == sorted(tuple(r) for r in df.collect())
    assert [r.line for r in bad.collect()] == ['{"z": broken']
    X.write_csv(df, str(tmp_path / "c"), ["a", "z"])
    back = X.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["a", "z"] and {r.a for r in back.collect()} >= {'a "b"\nc'}


def test_a_log_takes_each_key_once(spark, tmp_path):
    df = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("q", 1, "x")], "question_id string, applied_at int, v string")
    for rows in (df, df, df.withColumn("applied_at", F.col("applied_at") + 1)):
        tables.append_to_log(rows, str(tmp_path / "log"), "question_id", "applied_at")
    assert sorted(r.applied_at for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2, 3]


def test_files_of_an_archive(spark, tmp_path):
    for path in ("2025/A/x.txt", "2025/A/sub/y.txt", "2025/stray.txt", "misc/B/z.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("same")
    got = {r.relative_path: r for r in X.read_inventory_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"2025/A/x.txt", "2025/A/sub/y.txt"} and got["2025/A/sub/y.txt"].proposal_branch == "A"
    assert len({r.document_id for r in got.values()}) == 1 and got["2025/A/x.txt"].size_bytes == 4


def test_tracker_sheets_are_stacked_under_canonical_names(spark):
    assert X.tracker_headers(["Grant #", "", "Grant", " grant ", None or ""], {}) == ["grant", "column", "grant_2", "grant_3", "column_2"]
    a = spark.createDataFrame([(1, "P", " "), (2, " ", None), (3, None, "N3")], "n int, `Proposal Name` string, `Grant No` string")
    b = spark.createDataFrame([(1, "Q", "2024")], "n int, Title string, Year string")
    out = X.read_tracker({"a": a, "b": b}, {"grant_no": "grant_number", "title": "proposal_name"}, "n")
    got = sorted((r.sheet, r.row_number, r.proposal_name or "", r.grant_number or "") for r in out.collect())
    assert got == [("a", 1, "P", ""), ("a", 3, "", "N3"), ("b", 1, "Q", "")]
    assert out.select("row_id").distinct().count() == 3


def test_empty_tables(spark):
    schema = ST.StructType([ST.StructField("proposal_id", ST.StringType()), ST.StructField("v", ST.StringType())])
    empty = spark.createDataFrame([], schema)
    assert S.detect_conflict(empty, "v").count() == 0 and P.branch_signals(empty, "v", "v").count() == 0
