"""URL filter: rules first, then the likelihood ratio of two character language models.

URLs that a rule accepts or rejects train one variable-order Markov model each: counts of all runs of up to ORDER
characters of host and path, smoothed by their next shorter run (Witten-Bell). Other URLs get the difference of the two
log-likelihoods over their length; where it lies above a cut that rule-judged URLs outside the counts calibrate, the URL
is allowed. Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import cut, table

ORDER = 5
#: Fixed values of the contract: verdict by host and path.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Of the rule-judged URLs one in so many calibrates and isn't counted.
CALIBRATION = 4
BIN = 0.01
#: Smoothing of single characters: pseudo-count, and size of the alphabet.
PSEUDO, ALPHABET = 0.5, 256
#: Distinct runs up to this number are sent to all tasks (about 40 bytes each); more are joined by a shuffle.
RUNS_BOUND = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hint_for(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= RUNS_BOUND else df.hint("merge")


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every url; both empty if it is null or has no `://`."""
    url = F.coalesce("url", F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def runs(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character of host and path and their end: `g`, it and the ORDER - 1 characters before it."""
    text = F.concat(F.lit("^" * (ORDER - 1)), "host", "path", F.lit("$"))
    letters = urls.where("host <> '' or path <> ''").select(*keep, F.split(text, "").alias("_c"))
    places = F.sequence(F.lit(1), F.size("_c") - (ORDER - 1))
    grams = F.transform(places, lambda i: F.array_join(F.slice("_c", i, ORDER), ""))
    return letters.select(*keep, F.explode(grams).alias("g"))


def fit(judged: DataFrame) -> DataFrame:
    """(g, llr): log ratio accepted to rejected of each run of 1..ORDER characters seen in (host, path, verdict)."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    counted = runs(judged, "verdict").groupBy("g").agg(count("allow").alias("a"), count("block").alias("b"))
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.substr("g", F.lit(ORDER + 1) - k))
    every = (
        counted.select("a", "b", F.explode(suffixes).alias("g")).groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    every = cut(every.withColumn("k", F.length("g")).withColumn("h", F.expr("left(g, k - 1)")))
    context = every.groupBy("k", "h").agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"),
        F.count_if(F.expr("a > 0")).alias("ta"), F.count_if(F.expr("b > 0")).alias("tb"),
    )
    seen = cut(every.join(context.hint("shuffle_hash"), ["k", "h"]))
    single = lambda n, t: (F.col(n) + PSEUDO) / (F.col(t) + PSEUDO * ALPHABET)
    level = seen.where("k = 1").select("g", single("a", "na").alias("pa"), single("b", "nb").alias("pb"))
    out = level
    smooth = lambda n, t, d, p: F.when(F.col(d) > 0, (F.col(n) + F.col(d) * F.col(p)) / (F.col(t) + F.col(d))).otherwise(F.col(p))
    for k in range(2, ORDER + 1):
        lower = level.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        level = (
            seen.where(F.col("k") == k).withColumn("s", F.expr("right(g, k - 1)")).join(lower.hint("shuffle_hash"), "s")
            .select("g", smooth("a", "na", "ta", "qa").alias("pa"), smooth("b", "nb", "tb", "qb").alias("pb"))
        )
        out = out.union(level)
    return cut(out.select("g", F.log(F.col("pa") / F.col("pb")).alias("llr")))


def score(urls: DataFrame, model: DataFrame, *keep: str) -> DataFrame:
    """keep columns (which tell urls apart) and score: mean log ratio of their characters, each in the longest context
    that the models know."""
    every = runs(urls, *keep)
    distinct = cut(every.select("g").distinct())
    known = model.select(F.col("g").alias("s"), "llr")
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.substr("g", F.lit(ORDER + 1) - k))
    best = cut(
        distinct.select("g", F.explode(suffixes).alias("s"))
        .join(known.hint("shuffle_hash"), "s")
        .groupBy("g").agg(F.max_by("llr", F.length("s")).alias("llr"))
    )
    return (
        every.join(hint_for(best), "g", "left").groupBy(*keep).agg(F.round(F.avg(F.coalesce("llr", F.lit(0.0))), 9).alias("score"))
    )


def calibrated_cut(scores: DataFrame) -> float:
    """The cut with the least mean error rate of both classes over (verdict, score), the middle one of equals; 0 without
    both classes. Only counts of score bins are gathered."""
    bins = scores.groupBy(F.round(F.greatest(F.least("score", F.lit(20)), F.lit(-20)) / BIN).cast("int").alias("b")).agg(
        F.count_if(F.expr("verdict = 'allow'")).alias("a"), F.count_if(F.expr("verdict = 'block'")).alias("r")
    )
    rows = sorted((r["b"], r["a"], r["r"]) for r in bins.collect())
    allowed, rejected = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allowed or not rejected:
        return 0.0
    below_a, below_r, found = 0, 0, []
    for i, (b, a, r) in enumerate(rows):
        found.append((below_a / allowed + 1 - below_r / rejected, b, rows[i - 1][0] if i else b - 1))
        below_a, below_r = below_a + a, below_r + r
    least = min(found)[0]
    best = [x for x in found if x[0] <= least + 1e-12]
    _, high, low = best[len(best) // 2]
    return round(BIN * (low + high) / 2, 6)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page; score is null where a rule decides.

    Repeated rows, also of one page_id with several urls, are judged once each. A url without host and path has no
    characters and score 0. Without judged URLs of both kinds every score is 0 or undecided and the cut is 0, so
    everything without a rule is allowed.
    """
    rule, verdict = rule_of(rules)
    urls = with_parts(pages).withColumn("rule", rule).withColumn("verdict", verdict)
    judged = urls.where("verdict is not null").select("host", "path", "verdict")
    part = F.conv(F.left(F.md5(F.concat_ws("\n", "host", "path")), F.lit(6)), 16, 10).cast("int") % CALIBRATION
    model = fit(judged.where(part != 0))
    held = judged.where(part == 0).distinct()
    threshold = calibrated_cut(score(held, model, "host", "path", "verdict"))
    # Equal urls are scored once; a url is no hot key of the join, since copies of a page have pages of their own.
    open_urls = urls.where("verdict is null").select("host", "path").distinct()
    scores = cut(score(open_urls, model, "host", "path"))
    by_method = F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    joined = urls.join(scores.hint("merge"), ["host", "path"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")


def _rule_sql(at: int) -> str:
    fits = "".join(
        f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{(host + path, what)[at]}'"
        for host, path, what in sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    )
    return f"CASE{fits} END"


def _grams_sql(source: str, columns: str) -> str:
    text = f"(SELECT {columns}, '{'^' * (ORDER - 1)}' || host || path || '$' AS x FROM {source} WHERE host <> '' OR path <> '')"
    return f"(SELECT {columns}, substr(x, i, {ORDER}) AS g FROM (SELECT {columns}, x, unnest(range(1, length(x) - {ORDER - 2})) AS i FROM {text}))"


def _smooth_sql(n: str, d: str, t: str, p: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ({n} + {d} * {p}) / ({t} + {d}) ELSE {p} END"


def _levels_sql() -> str:
    one = lambda n, t: f"({n} + {PSEUDO}::DOUBLE) / ({t} + {PSEUDO * ALPHABET}::DOUBLE)"
    out = [f"p1 AS (SELECT g, {one('a', 'na')} AS pa, {one('b', 'nb')} AS pb FROM seen WHERE k = 1)"]
    for k in range(2, ORDER + 1):
        out.append(
            f"p{k} AS (SELECT s.g, {_smooth_sql('a', 'ta', 'na', 'l.pa')} AS pa, {_smooth_sql('b', 'tb', 'nb', 'l.pb')} AS pb "
            f"FROM seen s JOIN p{k - 1} l ON l.g = right(s.g, {k - 1}) WHERE k = {k})"
        )
    return ", ".join(out)


def _score_sql(source: str) -> str:
    return f"""(SELECT host, path, round(avg(coalesce(llr, 0.0)), 9) AS score FROM (SELECT host, path, g, i, arg_max(llr, k) AS llr
        FROM (SELECT *, unnest(range(1, {ORDER + 1})) AS z FROM (SELECT host, path, g, row_number() OVER () AS i FROM {_grams_sql(source, "host, path")})) LEFT JOIN model ON model.s = right(g, z) GROUP BY ALL) GROUP BY 1, 2)"""


#: The same models and cut in DuckDB's dialect.
ORACLE_SQL = f"""
WITH url0 AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
urls AS (SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS verdict, CAST('0x' || left(md5(host || chr(10) || path), 6) AS INTEGER) % {CALIBRATION} AS part FROM url0),
train AS (SELECT * FROM urls WHERE verdict IS NOT NULL AND part <> 0),
counted AS (SELECT g, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM {_grams_sql("train", "verdict")} GROUP BY 1),
ends AS (SELECT right(g, k) AS g, k, sum(a) AS a, sum(b) AS b FROM (SELECT *, unnest(range(1, {ORDER + 1})) AS k FROM counted) GROUP BY 1, 2),
seen AS (SELECT *, sum(a) OVER h AS na, sum(b) OVER h AS nb, count(*) FILTER (a > 0) OVER h AS ta, count(*) FILTER (b > 0) OVER h AS tb
    FROM (SELECT g, k, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM ends) WINDOW h AS (PARTITION BY k, left(g, k - 1))),
{_levels_sql()},
model AS (SELECT g AS s, length(g) AS k, ln(pa / pb) AS llr FROM ({" UNION ALL ".join(f"FROM p{k}" for k in range(1, ORDER + 1))})),
held AS (SELECT DISTINCT host, path, verdict FROM urls WHERE verdict IS NOT NULL AND part = 0),
held_scores AS (SELECT verdict, CAST(round(greatest(least(score, 20), -20) / {BIN}) AS INTEGER) AS b FROM held JOIN {_score_sql("held")} USING (host, path)),
bins AS (SELECT b, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS r FROM held_scores GROUP BY 1),
totals AS (SELECT sum(a) AS ta, sum(r) AS tr FROM bins),
rates AS (SELECT b, coalesce(lag(b) OVER (ORDER BY b), b - 1) AS low, (sum(a) OVER (ORDER BY b) - a) / ta + 1 - (sum(r) OVER (ORDER BY b) - r) / tr AS rate FROM bins, totals WHERE ta > 0 AND tr > 0),
best AS (SELECT *, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS n FROM rates WHERE rate <= (SELECT min(rate) FROM rates) + 1e-12),
cut AS (SELECT coalesce((SELECT round({BIN} * (low + b) / 2, 6) FROM best WHERE i = n // 2), 0.0) AS c),
open AS (SELECT DISTINCT host, path FROM urls WHERE verdict IS NULL),
scores AS (FROM {_score_sql("open")})
SELECT page_id, urls.host, urls.path, rule, coalesce(verdict, CASE WHEN coalesce(score, 0.0) >= c THEN 'allow' ELSE 'block' END) AS verdict
FROM urls LEFT JOIN scores ON scores.host = urls.host AND scores.path = urls.path, cut
"""
