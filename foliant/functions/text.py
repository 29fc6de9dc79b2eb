"""Scalar column functions: ids, names, tokens, small parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(sha256: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha256, 1, 16))


def slug(c: Column) -> Column:
    """Lower-case words joined by hyphens; `item` if nothing is left."""
    body = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(body, F.lit("-")), F.lit("")), F.lit("item"))


def group_id(year: Column, branch: Column) -> Column:
    path = F.concat_ws("/", year, branch)
    return F.concat(
        F.lit("prop_"), slug(F.concat_ws("__", year, branch)), F.lit("__"), F.substring(F.sha2(path, 256), 1, 8)
    )


def safe_file_name(c: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"\s+", "_")
    return F.coalesce(F.nullif(F.btrim(body, F.lit("._")), F.lit("")), F.lit("file"))


def recommended_key(*parts: Column) -> Column:
    """Parts joined by slashes; slashes around a part and empty parts are left out."""
    return F.array_join(F.filter(F.array(*(F.btrim(p, F.lit("/")) for p in parts)), lambda x: x != ""), "/")


def canonical_token(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def name_tokens(c: Column) -> Column:
    """Distinct letter and digit runs of two or more characters."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 1))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_unknown(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "unknown")


def strip_fences(c: Column) -> Column:
    """Without one Markdown fence around the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def parse_bool(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin("true", "yes", "y", "1"), True).when(word.isin("false", "no", "n", "0"), False)


def parse_list(c: Column) -> Column:
    """A JSON list of strings, or words between commas and bars; blanks left out."""
    words = F.transform(F.split(c, r"[,|]"), lambda x: F.trim(x))
    given = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(words)
    return F.filter(given, lambda x: x != "")


def any_word(text: Column, words) -> Column:
    """Whether the lower-case text holds one of the words. One pattern, as a chain of searches grows the generated code of
    each filter that repeats it beyond what Spark compiles."""
    return F.lower(text).rlike("|".join(re.escape(word) for word in words))


def first_rule(text: Column, rules, default: str | None) -> Column:
    """Value of the first rule of which the lower-case text holds a keyword."""
    out = F.lit(default).cast("string")
    for words, value in reversed(rules):
        out = F.when(any_word(text, words), value).otherwise(out)
    return out


def quota_error(message: Column) -> Column:
    """Whether an error says that the day's tokens are spent."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return low.contains("throttlingexception") & (low.contains("tokens per day") | low.contains("daily token"))


def safe_doc_title(file_name: Column) -> Column:
    """A file's stem with letters, digits, hyphens, brackets and single spaces; `document` if nothing is left."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    body = F.trim(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9\-()\[\] ]+", " "), r"\s+", " "))
    return F.coalesce(F.nullif(body, F.lit("")), F.lit("document"))


def request_text(c: Column, limit: int) -> Column:
    """Text for a request: at most `limit` characters under a line that says so; a line of its own for no text."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    note = F.concat(F.lit("[Cut from "), F.length(body), F.lit(f" to {limit} characters]\n\n"))
    cut = F.concat(note, F.regexp_replace(F.left(body, F.lit(limit)), r"\s+$", ""))
    return F.when(body == "", "(no text)").when(F.length(body) > limit, cut).otherwise(body)


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, white space as single spaces. Null gives an empty text."""
    body = F.coalesce(html, F.lit(""))
    for tag in ("script", "style"):
        body = F.regexp_replace(body, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"[ \t\r\n\f]+", " "))


def size_limit_error(strategy: Column, message: Column) -> Column:
    """Whether a direct upload failed for its size, so that extracted text may do."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (strategy == "direct_bedrock") & (low.contains("maximum document size") | low.contains("maximum of 100 pdf pages"))


def iso_date(c: Column) -> Column:
    """The date part of an ISO date or time stamp, other texts as they are; null for blanks."""
    text = F.nullif(F.trim(c), F.lit(""))
    day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    return F.coalesce(F.nullif(day, F.lit("")), text)


def latency_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with its {{name}} placeholders filled; null values leave nothing."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
