"""Readers and writers of an archive's files and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from foliant.functions import text as T


def read_inventory_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below `<root>/<year>/<group>` with size, time, hash and ids. Contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace("path", r"^[a-z0-9]+:/*", "")
    part = F.split("relative_path", "/")
    return (
        files.withColumn("relative_path", F.substring(path, F.lit(len(base) + 2), F.length(path)))
        .withColumn("sha256", F.sha2("content", 256))
        .where((F.size(part) >= 3) & F.element_at(part, 1).rlike(r"^20\d{2}$"))
        .select(
            "relative_path", F.element_at(part, 1).alias("year_folder"), F.element_at(part, 2).alias("proposal_branch"),
            F.element_at(part, -1).alias("file_name_original"), F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_time"), "sha256", T.document_id(F.col("sha256")).alias("document_id"),
        )
    )


def read_jsonl(spark: SparkSession, path: str, schema: ST.StructType) -> tuple[DataFrame, DataFrame]:
    """Typed records, and the lines that aren't such (column line). Blank lines are skipped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    wide = ST.StructType([*schema.fields, ST.StructField("_corrupt_record", ST.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.select("value", F.from_json("value", wide, options).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    good = parsed.where(~bad).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields))
    return good, parsed.where(bad).select(F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, keys in order; nulls are written."""
    fields = [F.col(f"`{c}`") for c in sorted(df.columns)]
    df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; every column is a string, quoted cells may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The listed columns in their order, other ones left out, a header in each file."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Standing policies (id, statement) of JSON files that hold one, or a list of them under `policies`. Ids are unique."""
    form = "policies array<struct<id:string,statement:string>>, id string, statement string"
    rows = spark.read.schema(form).option("multiLine", True).json(path)
    alone = F.when(F.col("id").isNotNull(), F.array(F.struct("id", "statement")))
    out = rows.select(F.explode(F.coalesce("policies", alone)).alias("p")).select("p.*")
    twice = out.groupBy("id").agg(F.count("*").alias("n"), F.count("statement").alias("m")).where("id is null or n > 1 or m = 0").first()
    if twice:
        raise ValueError(f"a policy has no id or statement, or its id twice: {twice['id']}")
    return out


EXPECTED = (
    "proposal_branch string, status string, award_status string, agency string, program string, document_count int, max_question_count int, "
    "authoritative_document_roles array<string>, excluded_from_rag_document_roles array<string>"
)


def read_expected_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What runs should come to: one JSON object a file. A file that doesn't name its group is an error."""
    rows = spark.read.schema(EXPECTED).option("multiLine", True).option("mode", "FAILFAST").json(folder)
    if rows.where("proposal_branch is null").first():
        raise ValueError("an expected outcome names no proposal_branch")
    return rows


def read_documents_by_id(spark: SparkSession, path: str, ids: DataFrame, key: str = "document_id", bound: int = 100_000) -> DataFrame:
    """Rows of a Parquet table of documents whose id is asked for. A list that is counted small goes to the scan, where row
    groups without any of the ids are skipped; a longer one is joined."""
    rows, wanted = spark.read.parquet(path), ids.select(key).distinct()
    few = wanted.limit(bound + 1).collect() if bound else []
    if len(few) <= min(bound, 1000):
        return rows.where(F.col(key).isin(*(r[0] for r in few)) if few else F.lit(False))
    return rows.join(F.broadcast(wanted) if len(few) <= bound else wanted.hint("merge"), key, "left_semi")


def tracker_headers(names: Sequence[str], aliases: dict[str, str]) -> list[str]:
    """Canonical column names: lower-case words joined by underscores, known aliases replaced, repeats numbered, blank
    ones called column."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        token = "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in raw.lower()).split()) or "column"
        token = aliases.get(token, token)
        seen[token] = seen.get(token, 0) + 1
        out.append(token if seen[token] == 1 else f"{token}_{seen[token]}")
    return out


def read_tracker(sheets: dict[str, DataFrame], aliases: dict[str, str], order: str) -> DataFrame:
    """Rows of all sheets below one another under canonical names, blanks null, rows without any value left out. `order`
    is a column with the row's number in its sheet, which stays the row's number if others are left out."""
    stacked = None
    for sheet, df in sheets.items():
        columns = [c for c in df.columns if c != order]
        names = tracker_headers(columns, aliases)
        rows = df.select(
            F.lit(sheet).alias("sheet"), F.col(f"`{order}`").alias("row_number"),
            *(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(n) for c, n in zip(columns, names, strict=True)),
        )
        rows = rows.where(F.coalesce(*(F.col(f"`{n}`") for n in names)).isNotNull())
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    named = [F.col(c) for c in ("proposal_name", "grant_number") if c in stacked.columns]
    label = F.concat_ws(":", "sheet", "row_number", F.coalesce(*named, F.lit("")))
    return stacked.withColumn("row_id", F.concat(F.lit("trk_"), F.substring(F.sha2(label, 256), 1, 12)))
