"""Model responses: reading JSON, known spellings of values, checks, and the split into good rows and failures."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from foliant import rules
from foliant.functions import text as T


#: An object begins with a brace before a key and its colon, or before its end.
START = re.compile(r'\{(?=[ \t\r\n]*(?:\}|"(?:[^"\\]|\\.)*+"[ \t\r\n]*:))', re.DOTALL)
#: Strings, the last one perhaps cut off, and brackets.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+\\?(?:"|\Z)|[{}\[\]]', re.DOTALL)
#: Of a text too deep for the parser, the outermost object of at most so many levels is read.
MOST_DEEP = 500


def unfit(text: str, start: int, end: int) -> set[int]:
    """Braces between start and end that begin no object: left open, closed by a wrong bracket, or too far above their
    deepest part."""
    stack, out = [], set()
    for m in TOKEN.finditer(text, start, end):
        c = m[0]
        if c in ("{", "["):
            stack.append([c, m.start(), 1])
        elif c in ("}", "]"):
            if not stack or stack[-1][0] + c not in ("{}", "[]"):
                break
            kind, at, levels = stack.pop()
            if kind == "{" and levels > MOST_DEEP:
                out.add(at)
            if not stack:
                break
            stack[-1][2] = max(stack[-1][2], levels + 1)
    return out | {at for kind, at, _ in stack if kind == "{"}


@F.pandas_udf(ST.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object that starts at any brace of a text; null for a null text or none. Every start is tried but
    those that a failed try has shown to fail like it, so long broken texts take little time."""
    decoder = json.JSONDecoder()

    def one(text: str | None) -> str | None:
        rest, base, dead = text or "", 0, set()
        step = 64 * math.isqrt(len(rest))
        for m in START.finditer(rest):
            at = m.start()
            if at in dead:
                continue
            if at - base > step:  # an error counts the lines before it, so the text before is left behind now and then
                rest, base = text[at:], at
            try:
                return json.dumps(decoder.raw_decode(rest, at - base)[0])
            except RecursionError:
                dead |= unfit(text, at, len(text))
            except ValueError as e:  # a number too long for Python has no place of the error
                dead |= unfit(text, at, base + getattr(e, "pos", at - base))
        return None

    return texts.map(one)


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def parse_strict(responses: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Adds body: the text without a fence if that is one JSON object as a whole, else null (arrays are failures)."""
    bare = T.strip_fences(F.col(raw))
    return responses.withColumn("body", F.when(is_object(bare), bare))


def parse_lenient(responses: DataFrame, raw: str = "raw_text") -> DataFrame:
    """As parse_strict, but a text that isn't an object gives the first object found in it. Only such texts reach Python."""
    strict = parse_strict(responses, raw)
    rest = F.when(F.col("body").isNull(), F.col(raw))
    return strict.withColumn("_found", first_object(rest)).withColumn("body", F.coalesce("body", "_found")).drop("_found")


def alias(c: Column, spellings: Mapping[str, str]) -> Column:
    """The listed value for a spelling, by canonical token; other values stay as they are."""
    token, out = T.canonical_token(c), c
    for spelling, value in spellings.items():
        out = F.when(token == spelling, value).otherwise(out)
    return out


def program(c: Column) -> Column:
    token, out = T.canonical_token(c), c
    for name in rules.PROGRAM_PREFIXES:
        out = F.when(token.startswith(name.lower()), name).otherwise(out)
    return out


def response_fields(parsed: DataFrame) -> DataFrame:
    """Adds the response's values as columns, in their canonical spelling; absent ones are null."""
    at = lambda path: F.get_json_object("body", f"$.{path}")
    fields = {p.rsplit(".", 1)[-1]: alias(at(p), spellings) for p, spellings in rules.RESPONSE_ALIASES.items()}
    fields["program"] = program(at("proposal_context.program"))
    fields["confidence"] = at("confidence.document_category").cast("double")
    return parsed.withColumns(fields)


def with_violations(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Adds violations: names of the checks that a row doesn't hold, in the order given. A check that is null fails."""
    broken = [F.when(~F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def response_checks() -> dict[str, Column]:
    category = F.col("document_category")
    return {
        "object": F.col("body").isNotNull(),
        "document_category": category.isNotNull() & category.isin(*rules.CATEGORIES),
        "confidence": F.col("confidence").between(0, 1),
    }


#: Values of a response by path, with what they may be.
ENUMS = {
    "document_identity.document_category": rules.CATEGORIES, "document_identity.document_role": rules.ROLES, "document_identity.origin_type": rules.ORIGINS,
    "document_identity.version_status": rules.VERSIONS, "opportunity_treatment.recommended_rag_treatment": (*rules.TREATMENTS, "manual_review"),
    "inclusion.rag_priority": rules.PRIORITIES, "proposal_context.status": rules.STATUSES, "proposal_context.program": rules.PROGRAMS,
}
#: Values with a confidence each, and the longest title.
SURE_OF = ("document_category", "document_role", "origin_type", "version_status", "rag_priority")
LONGEST_TITLE = 500


def canonical_fields(parsed: DataFrame) -> DataFrame:
    """Adds value, a map by path of a response's values in their canonical spelling (absent ones are left out), sure, a map of
    its confidences, and title."""
    at = lambda path: F.get_json_object("body", f"$.{path}")
    spelled = {p: program(at(p)) if p.endswith(".program") else alias(at(p), rules.RESPONSE_ALIASES.get(p, {})) for p in ENUMS}
    pairs = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(p).alias("k"), c.alias("v"))) for p, c in spelled.items()))
    sure = F.array(*(F.when(at(f"confidence.{f}").isNotNull(), F.struct(F.lit(f).alias("k"), at(f"confidence.{f}").try_cast("double").alias("v"))) for f in SURE_OF))
    return parsed.withColumns(
        {
            "value": F.map_from_entries(F.array_compact(pairs)), "sure": F.map_from_entries(F.array_compact(sure)),
            "title": at("document_identity.canonical_document_title"),
        }
    )


def record_checks() -> dict[str, Column]:
    """Checks of canonical_fields: an object; every value there is one of its list; category and role are there; every
    confidence is a number from 0 to 1, and the category has one; the title isn't blank or too long."""
    given = lambda p: F.try_element_at("value", F.lit(p))
    needed = ("document_identity.document_category", "document_identity.document_role")
    out = {"object": F.col("body").isNotNull()}
    for path, allowed in ENUMS.items():
        held = given(path).isin(*allowed)
        out[path] = F.coalesce(held, F.lit(False)) if path in needed else F.coalesce(held, F.lit(True))
    for field in SURE_OF:
        number = F.try_element_at("sure", F.lit(field))
        there = F.coalesce(F.array_contains(F.map_keys("sure"), F.lit(field)), F.lit(False))
        fine = F.coalesce(number.between(0, 1), F.lit(False))
        out[f"confidence.{field}"] = fine if field == "document_category" else ~there | fine
    title = F.trim("title")
    out["title"] = title.isNull() | ((title != "") & (F.length(title) <= LONGEST_TITLE))
    return out


def validate(rows: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold all checks, and the others."""
    checked = with_violations(rows, checks)
    return checked.where("size(violations) = 0").drop("violations"), checked.where("size(violations) > 0")


def failures(bad: DataFrame, raw: str = "raw_text", preview: int = 500) -> DataFrame:
    """Dead letters: first violation, all of them, and the start of the text for people to look at."""
    return bad.withColumns(
        {"error_type": F.element_at("violations", 1), "details": F.array_join("violations", ","), "preview": F.left(F.col(raw), F.lit(preview))}
    )


def as_variants(body: Column, path: str) -> Column:
    """The list at a path of a JSON text as array<variant>; null if there is none."""
    return F.try_variant_get(F.try_parse_json(body), path, "array<variant>")


def text_at(item: Column, key: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(item, f"$.{key}", "string")), F.lit(""))


def is_text(item: Column) -> Column:
    return F.schema_of_variant(item) == "STRING"


def first_text(item: Column) -> Column:
    """The first text among an object's values, in the order of their keys."""
    values = F.map_values(F.try_variant_get(item, "$", "map<string,variant>"))
    texts = F.transform(F.filter(values, lambda v: is_text(v)), lambda v: F.trim(F.variant_get(v, "$", "string")))
    return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1))


# Keys under which responses name partners and list items, in order of preference.
PARTNER_KEYS = ("name", "organization", "partner_name", "institution", "company")
ITEM_KEYS = ("milestone", "deliverable", "risk", "name", "title", "description", "date")


def partners(body: Column) -> Column:
    """Names of the partners of a response: texts as they are, objects by the first of PARTNER_KEYS or else any text."""
    own = lambda v: F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit(""))
    name = lambda v: F.when(is_text(v), own(v)).otherwise(F.coalesce(*(text_at(v, k) for k in PARTNER_KEYS), first_text(v)))
    return F.array_compact(F.transform(as_variants(body, "$.proposal_context.partners"), name))


def list_items(body: Column, field: str) -> Column:
    """Risks, milestones or deliverables as texts: texts as they are, objects as their known values joined by dashes."""
    own = lambda v: F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit(""))
    known = lambda v: F.nullif(F.array_join(F.array_compact(F.array(*(text_at(v, k) for k in ITEM_KEYS))), " - "), F.lit(""))
    item = lambda v: F.when(is_text(v), own(v)).otherwise(F.coalesce(known(v), first_text(v)))
    return F.array_compact(F.transform(as_variants(body, f"$.content.{field}"), item))


UNCERTAINTY = "array<struct<field:string,scope:string,current_guess:string,confidence:double,downstream_impact:string,reason_unresolved:string>>"


def uncertainties(body: Column) -> Column:
    """A response's uncertainties, and after them its questions of the older form as such."""
    given = F.coalesce(F.from_json(F.get_json_object(body, "$.uncertainties"), UNCERTAINTY), F.array().cast(UNCERTAINTY))
    form = "array<struct<field:string,question:string,notes:string,priority:string,model_guess:string>>"
    asked = F.coalesce(F.from_json(F.get_json_object(body, "$.questions_for_user"), form), F.array().cast(form))
    level = lambda q: F.lower(F.trim(F.coalesce(q["priority"], F.lit(""))))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    folded = lambda q: F.struct(
        F.coalesce(blank(q["field"]), F.lit("unknown")).alias("field"), F.lit("document").alias("scope"), q["model_guess"].alias("current_guess"),
        F.lit(0.5).alias("confidence"), F.when(level(q).isin("critical", "high", "medium"), level(q)).otherwise("low").alias("downstream_impact"),
        F.coalesce(F.nullif(F.concat_ws(" ", blank(q["question"]), blank(q["notes"])), F.lit("")), F.lit("A question of the older form.")).alias("reason_unresolved"),
    )
    return F.concat(given, F.transform(asked, folded))


def system_fields(responses: DataFrame, inventory: DataFrame, owned: tuple[str, ...]) -> DataFrame:
    """Responses with the pipeline's own fields: whatever a response says of them, the inventory's values count."""
    side = inventory.select("doc_id", *owned)
    return responses.drop(*owned).join(side.hint("merge"), "doc_id")


def inclusion_checks() -> dict[str, Column]:
    """An included document says why; one left out of both sets says why not."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kept = F.col("include_in_clean_set") | F.col("include_in_future_rag")
    return {"include_reason": ~kept | given("include_reason"), "exclude_reason": kept | given("exclude_reason")}


def closed_record(body: Column, allowed: tuple[str, ...], required: tuple[str, ...]) -> dict[str, Column]:
    """Checks of a JSON object that must have some fields and may have no others."""
    keys = F.json_object_keys(body)
    return {
        "required": F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0,
        "closed": F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0,
    }
