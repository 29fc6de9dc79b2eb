"""Queries against their SQL where contents have many copies: in several roles, with other labels, under one path."""

import os

import pytest
from oracle import TABLES, connect, differences

from foliant.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("copies")
    for t in TABLES:
        if t not in ("documents", "labels"):
            os.symlink(f"{SF}/{t}.parquet", home / f"{t}.parquet")
    rows = spark.range(2400).unionByName(spark.range(2400, 120000).where("id % 97 = 0"))
    text = "concat('text ', (id div 240) * 4 + id % 4, ' ', (id div 20) % 12 % 3) as text"
    rows.selectExpr("id as doc_id", text, "'en' as lang", "'web' as source", "10L as n_chars").write.parquet(f"{home}/documents.parquet")
    rows.where("id % 3 <> 0").selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic").write.parquet(f"{home}/labels.parquet")
    con = connect(SF)
    for t in ("documents", "labels"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{home}/{t}.parquet/*.parquet'")
    return str(home), con


@pytest.mark.parametrize("name", ["choose_authoritative", "export_questions", "reviewed_answers", "deck_answers", "reviewed_documents"])
def test_copies_match_the_sql(spark, copies, name):
    home, con = copies
    assert differences(spark, con, registry.queries()[name], registry.oracle_sql()[name], home) == []


def test_a_page_names_the_files_it_lists(spark, tmp_path):
    """Two files of a group and role have one content, and one of them, not always the first, is kept."""
    for t in TABLES:
        if t not in ("documents", "labels"):
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = spark.range(480)
    rows.selectExpr("id as doc_id", "concat('text ', id div 40, ' ', id % 20) as text", "'en' as lang", "'web' as source", "10L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows.selectExpr("id as doc_id", "cast((id div 20 + id % 3) % 2 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    con = connect(SF)
    for t in ("documents", "labels"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert differences(spark, con, registry.queries()["folder_page"], registry.oracle_sql()["folder_page"], str(tmp_path)) == []
