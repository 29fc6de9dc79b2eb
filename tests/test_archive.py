from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import aggregates as A
from foliant.operators import inventory as I
from foliant.operators import tracker as M
from foliant.streaming import jobs


def test_tie_gives_the_fallback_and_first_seen_breaks_it(spark):
    df = spark.createDataFrame(
        [("g", "b", 1), ("g", "a", 2), ("g", "", 3), ("g", None, 4), ("h", "x", 1), ("h", "x", 2), ("h", "y", 3), ("i", "unknown", 1)],
        "k string, v string, o int",
    )
    got = {r.k: (r.v, r.n_votes) for r in A.consensus(df, "k", "v", "o").collect()}
    assert got == {"g": ("unknown", 1), "h": ("x", 2), "i": ("unknown", 0)}
    assert {r.k: r.v for r in A.most_common_known(df, "k", "v", "o").collect()} == {"g": "b", "h": "x"}
    assert {r.k: r.v for r in A.first_non_null(df, "k", "v", "o").collect()}["g"] == "b"


def test_ordered_union_keeps_first_appearance_at_any_partitioning(spark):
    df = spark.createDataFrame([("g", ["c", "a"], 2), ("g", ["a", "b", " "], 1), ("g", None, 3)], "k string, l array<string>, o int")
    for n in (1, 3, 50):
        got = A.ordered_union(df.repartition(n), "k", "l", "o").first()
        assert got.l == ["a", "b", "c"]
    assert A.ordered_union(df.limit(0), "k", "l", "o").count() == 0


def inventory_rows(spark, rows):
    return spark.createDataFrame(
        [(p, p.rsplit("/", 1)[-1], p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "." + p.rsplit(".", 1)[-1].lower(), f"doc_{i}", p.lower(), h) for i, (p, h) in enumerate(rows)],
        "relative_path string, file_name_original string, stem string, extension string, document_id string, scan_ord string, sha256 string",
    )


def test_decks_and_their_pdfs(spark):
    inv = inventory_rows(
        spark,
        [("2025/A/Deck.pptx", "a"), ("2025/A/deck.PDF", "b"), ("2025/A/Deck final.pptx", "c"), ("2025/a/Deck.pptx", "d")],
    )
    got = {r.relative_path: r.superseded_by_document_id for r in I.mark_superseded_by_pdf(inv).collect()}
    assert got["2025/A/Deck.pptx"] == "doc_1"
    assert got["2025/A/Deck final.pptx"] is None and got["2025/a/Deck.pptx"] is None
    assert I.slide_questions(inv).count() == 2


def test_hidden_and_temporary_files(spark):
    inv = inventory_rows(spark, [("2025/A/.git/x.txt", "a"), ("2025/A/~$x.docx", "b"), ("2025/A/x.docx", "c")])
    assert [r.relative_path for r in I.drop_temp_office(I.drop_hidden(inv)).collect()] == ["2025/A/x.docx"]


def test_text_functions(spark):
    df = spark.createDataFrame([('  A<b>:c d.pdf', '["x", "", "y"]', "Yes"), ("._.", "a| b,,c", "maybe"), (None, None, None)], "a string, b string, c string")
    got = df.select(T.safe_file_name(F.col("a")).alias("a"), T.parse_list(F.col("b")).alias("b"), T.parse_bool(F.col("c")).alias("c")).collect()
    assert got[0].a.endswith("c_d.pdf") and got[0].b == ["x", "y"] and got[0].c is True
    assert got[1].a == "file" and got[1].b == ["a", "b", "c"] and got[1].c is None
    assert got[2].b is None and got[2].c is None


def test_tracker_match_needs_a_lead(spark):
    groups = spark.createDataFrame([("p1", "Navy SBIR Radar"), ("p2", "Solo"), ("p3", "Army Tank Study")], "proposal_id string, proposal_branch string")
    rows = spark.createDataFrame([("r1", "Navy SBIR Radar"), ("r2", "Army Tank Study"), ("r3", "Study Tank Army"), ("r4", None)], "row_id string, proposal_name string")
    got = {r.proposal_id: (r.match_status, r.row_id) for r in M.match_tracker(groups, rows).collect()}
    assert got == {"p1": ("matched", "r1"), "p2": ("unmatched", None), "p3": ("ambiguous", None)}


def test_answers_stream_equals_its_batch(spark, tmp_path):
    rows = [("g", "f", f"v{i}", i) for i in range(6)] + [("h", "f", "w", 1)]
    schema = "group_id string, field_key string, applied_value string, seq long"
    for i in range(2):
        spark.createDataFrame(rows[i::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = jobs.latest_answers(log, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.group_id, r.applied_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("g", "v5"), ("h", "w")}


def test_entry_imports_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "foliant", tmp_path / "foliant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'duplicate_groups' in q and not any(k.startswith('op1') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
