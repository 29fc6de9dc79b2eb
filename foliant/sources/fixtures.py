"""Derived views over the given tables that stand in for an archive: inventory, tracker rows, decisions, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T

AGENCIES = ("DOE", "Army", "NSF", "Navy", "NASA", "Private")
PROGRAMS = ("SBIR", "STTR", "FOA", "BAA", "Prize")
PHRASES = (
    "Technical Volume", "Project Description", "Commercialization Plan", "Statement of Work", "Budget",
    "Reviewer Feedback", "Award Notice", "NOFO Solicitation", "Evaluation Criteria", "Support Letter", "Team Biosketch",
    "Misc Notes",
)
VERSIONS = (" FINAL", " DRAFT", "", " submitted", " superseded")
EXTENSIONS = (".pdf", ".docx", ".xlsx", ".txt", ".md", ".doc", ".png", ".zip", ".csv", ".PDF")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an archive's file has of its document: its text, and what is made of it."""
    text = F.coalesce("text", F.lit(""))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.col("n_chars").alias("size_bytes"), F.sha2(text, 256).alias("sha256"), text.alias("summary_short"), F.trim(text).alias("summary_detailed"))
        .withColumn("document_id", T.document_id(F.col("sha256")))
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document as if it were a file of an archive."""
    return files(contents(spark, sf_dir))


def files(found: DataFrame) -> DataFrame:
    """Contents, and columns beside theirs, with folders, names and groups. All of these follow from doc_id, so contents are
    joined to others before they get them."""
    d = F.col("doc_id")
    own = ("doc_id", "document_id", "sha256", "size_bytes", "summary_short", "summary_detailed")
    more = [c for c in found.columns if c not in own]
    s, k, g = F.col("s"), F.col("k"), F.col("g")
    deck = ((s % 4 == 0) & k.isin(7, 8)) | ((s % 4 == 1) & (k == 8))
    meeting = (s % 5 == 2) & k.isin(3, 4)
    year = (2018 + s % 7).cast("string")
    branch = F.when(g % 11 == 3, F.concat(F.lit("Solo Venture "), g)).otherwise(
        F.concat_ws(" ", year, pick(AGENCIES, s % 6), pick(PROGRAMS, s % 5), F.lit("Project"), g)
    )
    phrase = F.concat(pick(PHRASES, (F.floor(k / 2) + s) % 12), pick(VERSIONS, (k + s) % 5))
    stem = F.when(deck, "Briefing Deck").when(meeting & (k == 3), "Meeting Notes").when(meeting, "Meeting_Notes").otherwise(phrase)
    ext = (
        F.when(deck & (k == 7), ".pdf").when(deck, ".pptx").when(meeting, ".txt").otherwise(pick(EXTENSIONS, (d * 7) % 10))
    )
    prefix = F.when(d % 53 == 0, ".").when(d % 59 == 0, "~$").otherwise("")
    stray = d % 97 == 0
    folder = F.when((((k % 5 == 4) & ~deck) | (meeting & (k == 4))) & ~stray, "Appendix/").otherwise("")
    return (
        found
        .withColumn("s", d % 20)
        .withColumn("k", F.floor(d / 20) % 12)
        .withColumn("g", F.floor(d / 240) * 20 + d % 20)
        .withColumn("year_folder", year)
        .withColumn("proposal_branch", F.when(stray, F.lit(None)).otherwise(branch))
        .withColumn("extension", ext)
        .withColumn("stem", F.concat(prefix, stem))
        .withColumn("file_name_original", F.concat("stem", "extension"))
        .withColumn("relative_path", F.concat_ws("/", "year_folder", "proposal_branch", F.concat(folder, "file_name_original")))
        .withColumn("proposal_id", T.group_id(F.col("year_folder"), F.col("proposal_branch")))
        .select(
            "doc_id", "document_id", "sha256", "proposal_id", "year_folder", "proposal_branch", "relative_path",
            "file_name_original", "stem", F.lower("extension").alias("extension"), "size_bytes",
            F.concat_ws("|", F.lower("year_folder"), F.lower(F.coalesce("proposal_branch", F.lit(""))), F.lower("relative_path"), F.lpad(d.cast("string"), 12, "0")).alias("scan_ord"),
            "g", "summary_short", "summary_detailed", *more,
        )
    )


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same view for DuckDB, as common table expressions.
INVENTORY_SQL = f"""
inv0 AS (SELECT *, doc_id % 20 AS s, (doc_id // 20) % 12 AS k, (doc_id // 240) * 20 + doc_id % 20 AS g FROM documents),
inv1 AS (SELECT *, CAST(2018 + s % 7 AS VARCHAR) AS year_folder,
    (s % 4 = 0 AND k IN (7, 8)) OR (s % 4 = 1 AND k = 8) AS deck, s % 5 = 2 AND k IN (3, 4) AS meeting FROM inv0),
inv2 AS (SELECT *, CASE WHEN doc_id % 97 = 0 THEN NULL WHEN g % 11 = 3 THEN 'Solo Venture ' || g
        ELSE year_folder || ' ' || {_list(AGENCIES)}[s % 6 + 1] || ' ' || {_list(PROGRAMS)}[s % 5 + 1] || ' Project ' || g END
        AS proposal_branch,
    CASE WHEN deck AND k = 7 THEN '.pdf' WHEN deck THEN '.pptx' WHEN meeting THEN '.txt'
        ELSE {_list(EXTENSIONS)}[(doc_id * 7) % 10 + 1] END AS ext,
    CASE WHEN doc_id % 53 = 0 THEN '.' WHEN doc_id % 59 = 0 THEN '~$' ELSE '' END ||
    CASE WHEN deck THEN 'Briefing Deck' WHEN meeting AND k = 3 THEN 'Meeting Notes' WHEN meeting THEN 'Meeting_Notes'
        ELSE {_list(PHRASES)}[(k // 2 + s) % 12 + 1] || {_list(VERSIONS)}[(k + s) % 5 + 1] END AS stem,
    CASE WHEN doc_id % 97 <> 0 AND ((k % 5 = 4 AND NOT deck) OR (meeting AND k = 4)) THEN 'Appendix/' ELSE '' END AS folder FROM inv1),
inv3 AS (SELECT *, stem || ext AS file_name_original, sha256(coalesce(text, '')) AS sha256,
    concat_ws('/', year_folder, proposal_branch, folder || stem || ext) AS relative_path FROM inv2),
inventory AS (SELECT doc_id, 'doc_' || left(sha256, 16) AS document_id, sha256,
    'prop_' || coalesce(nullif(trim(regexp_replace(lower(trim(concat_ws('__', year_folder, proposal_branch))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')
        || '__' || left(sha256(concat_ws('/', year_folder, proposal_branch)), 8) AS proposal_id,
    year_folder, proposal_branch, relative_path, file_name_original, stem, lower(ext) AS extension, n_chars AS size_bytes,
    lower(year_folder) || '|' || lower(coalesce(proposal_branch, '')) || '|' || lower(relative_path) || '|' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS scan_ord,
    g, coalesce(text, '') AS summary_short, trim(coalesce(text, '')) AS summary_detailed FROM inv3)
"""


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker rows: one per group, some renamed, some doubled by an amendment. Orders whose key lies outside the range of
    groups' keys are left where they are read; the others go through one shuffle, with four short columns. The amendment is
    made of the row that it amends."""
    g, day = F.col("o_orderkey").alias("g"), F.col("o_orderdate").cast("date").alias("day")
    o = table(spark, sf_dir, "orders").select(g, day, "o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("p"))
    inside = inventory(spark, sf_dir).where("proposal_branch is not null")
    groups = inside.groupBy("g").agg(F.min("proposal_branch").alias("branch"))
    least, most = inside.agg(F.min("g"), F.max("g")).first()
    rows = o.where((F.col("g") % 11 != 3) & F.col("g").between(least, most)).join(groups.hint("merge"), "g")
    rows = rows.withColumn("part", F.explode(F.when(F.col("g") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    name = (
        F.when(F.col("g") % 7 == 0, "Unrelated Survey Vessel")
        .when(F.col("g") % 3 == 0, F.regexp_replace("branch", r" \S+$", ""))
        .otherwise(F.col("branch"))
    )
    status = F.when(F.col("o_orderstatus") == "F", "awarded").when(F.col("o_orderstatus") == "O", "submitted").otherwise("rejected")
    on = lambda n: F.date_format(F.date_add("day", n), "yyyy-MM-dd")
    return rows.select(
        "g", F.when(F.col("part") == 1, F.concat(name, F.lit(" Amendment"))).otherwise(name).alias("proposal_name"),
        status.alias("status"), on(0).alias("submission_date"), "part",
        F.when(F.col("p") == "1", "selected").when(F.col("p") == "2", "declined").alias("award_status"),
        F.when(F.col("p") == "3", "under way").alias("result"),
        F.when(F.col("g") % 2 == 0, on(90)).alias("selection_notification_date"), F.when(F.col("g") % 4 == 0, on(120)).alias("award_date"),
    ).withColumn("row_id", F.concat(F.lit("trk_"), F.substring(F.sha2(F.concat_ws(":", "g", "part", "proposal_name"), 256), 1, 12)))


TRACKER_SQL = r"""
groups AS (SELECT g, min(proposal_branch) AS branch FROM inventory WHERE proposal_branch IS NOT NULL GROUP BY g),
base AS (SELECT o_orderkey AS g, CASE WHEN o_orderkey % 7 = 0 THEN 'Unrelated Survey Vessel'
        WHEN o_orderkey % 3 = 0 THEN regexp_replace(branch, ' \S+$', '') ELSE branch END AS proposal_name,
    CASE o_orderstatus WHEN 'F' THEN 'awarded' WHEN 'O' THEN 'submitted' ELSE 'rejected' END AS status,
    strftime(o_orderdate, '%Y-%m-%d') AS submission_date, 0 AS part,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'selected' WHEN '2' THEN 'declined' END AS award_status,
    CASE WHEN left(o_orderpriority, 1) = '3' THEN 'under way' END AS result,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') END AS selection_notification_date,
    CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate + INTERVAL 120 DAY, '%Y-%m-%d') END AS award_date
    FROM orders JOIN groups ON g = o_orderkey WHERE o_orderkey % 11 <> 3),
both_parts AS (SELECT * FROM base UNION ALL
    SELECT * REPLACE (proposal_name || ' Amendment' AS proposal_name, 1 AS part) FROM base WHERE g % 5 = 0),
tracker AS (SELECT *, 'trk_' || left(sha256(concat_ws(':', g, part, proposal_name)), 12) AS row_id FROM both_parts)
"""


def uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open decisions: one per event, grouped by user."""
    k = F.get_json_object("props", "$.k").cast("int")
    impact = F.when(k < 25, 0).when(k < 50, 1).when(k < 75, 2).otherwise(3)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("group_id"), F.concat(F.lit("proposal_context."), "event_type").alias("field"),
        F.concat(F.lit("v"), k).alias("guess"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        impact.alias("impact"), F.array(F.col("event_type"), F.concat(F.lit("k"), k)).alias("evidence"),
        F.col("event_id").alias("ord"), k.alias("k"), "ts", "event_type", "value",
    )


UNCERTAIN_SQL = """
unc0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
unc AS (SELECT user_id AS group_id, 'proposal_context.' || event_type AS field, 'v' || k AS guess,
    least(value / 500, 1.0) AS confidence, CASE WHEN k < 25 THEN 0 WHEN k < 50 THEN 1 WHEN k < 75 THEN 2 ELSE 3 END AS impact,
    [event_type, 'k' || k] AS evidence, event_id AS ord, k, ts, event_type, value FROM unc0)
"""
