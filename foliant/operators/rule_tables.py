"""Ordered keyword rules given as a table: any number of them, in one pass over the texts.

A rule set is a chain: of its rules whose keyword occurs in a text, the one of the least ordinal decides. A handful of rules is
best compiled into expressions (functions.text.first_rule). Thousands are matched by an automaton over all keywords, which
reads a text once however many there are; it is built once a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of keywords and values in one automaton; larger tables are matched in several.
BLOCK_CHARS = 8_000_000
FOUND = "array<struct<rule_set:string,ordinal:long,value:string>>"


def prepared(rules: DataFrame) -> DataFrame:
    """rule_set, keyword, ordinal, value of the rules that can match: keywords in lower case, blank ones left out; of one
    keyword in a set the least ordinal, then the least value."""
    rows = rules.where("rule_set is not null and ordinal is not null and length(keyword) > 0")
    return rows.groupBy("rule_set", F.lower("keyword").alias("keyword")).agg(F.min(F.struct(F.col("ordinal").cast("long").alias("ordinal"), "value")).alias("r")).select(
        "rule_set", "keyword", "r.ordinal", "r.value"
    )


def rule_blocks(rules: DataFrame, chars: int) -> Iterator[list[tuple]]:
    """Prepared rules in blocks of bounded size, one at a time."""
    size = F.length("keyword") + F.length(F.coalesce("value", F.lit(""))) + F.length("rule_set")
    n = max(1, -(-int(rules.agg(F.sum(size)).first()[0] or 0) // chars))
    part = F.pmod(F.xxhash64("rule_set", "keyword"), F.lit(n))
    for i in range(n):
        yield [tuple(r) for r in rules.where(part == i).collect()]


def first_matches(block: list[tuple], spark):
    """A column function: for each rule set with a match in a text, its rule of the least ordinal."""
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        of: dict[str, list[tuple]] = {}
        for rule_set, keyword, ordinal, value in shared.value:
            of.setdefault(keyword, []).append((rule_set, ordinal, value))
        automaton = ahocorasick.Automaton()
        for keyword, rules in of.items():
            automaton.add_word(keyword, rules)
        if of:
            automaton.make_automaton()

        def one(text: str | None) -> list[dict]:
            best: dict[str, tuple] = {}
            for _, rules in automaton.iter(text) if of and text else ():
                for rule_set, ordinal, value in rules:
                    key = (ordinal, value is not None, value or "")
                    if rule_set not in best or key < best[rule_set]:
                        best[rule_set] = key
            return [{"rule_set": s, "ordinal": o, "value": v if given else None} for s, (o, given, v) in best.items()]

        for texts in batches:
            yield texts.map(one)

    return found


def apply_rules(rows: DataFrame, text: str, rules: DataFrame, into: str = "matched", chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds map<rule_set, value>: for each set of rules (rule_set, ordinal, keyword, value) with a keyword in the text,
    whatever its case, the value of the least ordinal; of equal ordinals the least value. Null texts match nothing."""
    lower, parts, out = F.lower(F.col(text)), [], rows
    for i, block in enumerate(rule_blocks(prepared(rules), chars)):
        name = f"_found_{i}"
        out = out.withColumn(name, first_matches(block, rows.sparkSession)(lower))
        parts.append(name)
    every = F.array_sort(F.flatten(F.array(*parts)))  # by set, then ordinal, then value
    first = F.filter(every, lambda x, i: (i == 0) | (F.get(every, i - 1)["rule_set"] != x["rule_set"]))
    kept = first if len(parts) > 1 else F.col(parts[0])
    return out.withColumn(into, F.map_from_entries(F.transform(kept, lambda x: F.struct(x["rule_set"], x["value"])))).drop(*parts)
