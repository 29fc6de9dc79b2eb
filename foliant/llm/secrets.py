"""Secret scans with linking of multipart credentials.

Parts of credentials are found in each whole text. Strong ones (the base patterns) are reported as they are. Weak ones,
such as a bare random token, a client name or an endpoint, say little alone: they are reported only when a complementary
part lies near, in the same scope (the stretch between blank lines). Nearness is an interval join of the parts of a
scope: a secret's reach and all of an id or endpoint fall into buckets of that length, parts join by text, scope and
bucket, and what is left is compared exactly. A bucket holds few parts, because parts have a least length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import cut, fresh, sliced, strings, table

#: Fixed patterns of the base kinds. All patterns are ASCII, so texts are searched as Latin-1 bytes, one a code point.
ASSIGN = re.compile(
    rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    rb"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: Parts of credentials that count only beside a complementary part: kind, role, lower-case strings of which a text with
#: such a part holds one, pattern.
WEAK = (
    (
        "part_id",
        "id",
        (b"client", b"access", b"account", b"user", b"login"),
        re.compile(
            rb"(?:client[_-]?id|access[_-]?key(?:[_-]?id)?|account|user(?:name)?|login)"
            rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._+-]{4,})",
            re.IGNORECASE,
        ),
    ),
    ("part_secret", "secret", (), re.compile(rb"[A-Za-z0-9+/_-]{20,}={0,2}")),
    (
        "part_endpoint",
        "endpoint",
        (b"://", b"endpoint", b"host", b"server", b"region", b"url"),
        re.compile(
            rb"(?:endpoint|host|server|region|url)[\"']?\x20*[:=]\x20*[\"']?((?:[a-z]+://)?[A-Za-z0-9.-]{4,}(?::\d+)?)",
            re.IGNORECASE,
        ),
    ),
)
#: An endpoint is also a scheme of these, letters after it, `://` and four characters or more. It is found from the `://`.
SCHEME = re.compile(rb"jdbc:|postgres|mysql|mongodb|redis|amqp|s3|https?", re.IGNORECASE)
AFTER_SCHEME = re.compile(rb"[^ \t\n\r\f\v\"'<>]{4,}")
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+:")
MIXED = (re.compile(rb"[0-9]"), re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"))
#: Lower-case strings of which a text with an assignment holds one.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_RUN = bytes(49 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
TOKEN_RUN = bytes(49 if i < 128 and (chr(i).isalnum() or chr(i) in "+/_-") else 32 for i in range(256))
#: What a base span is a part of.
ROLE = {"assign": "secret", "access": "id", "hex": "secret"}
KINDS = ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")
BASE_KINDS = KINDS[:3]
#: Code points between two parts that belong together; also the length of the buckets they are joined by.
REACH = 200
SCOPE = re.compile(rb"\n[ \t\r]*\n")
#: Distinct texts with linked parts up to this number are sent to all tasks.
LINKED_BOUND = 100_000
PART = "array<struct<kind:int,role:string,start:int,end:int,scope:int>>"


def base_spans(text: bytes, lower: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, not overlapping by kind, short ones dropped."""
    found = []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"1" * 32 in text.translate(HEX_RUN):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scheme_ends(text: bytes) -> Iterator[tuple[int, int]]:
    """Where the letters before each `://` begin, with a scheme that ends in a digit, and where its slashes are."""
    last = 0
    for m in re.finditer(b"://", text):
        start = m.start()
        while start > last and text[start - 1] in LETTERS:
            start -= 1
        if text[max(start - 2, last) : start].lower() == b"s3":
            start -= 2
        yield start, m.start() + 1
        last = m.end()


def endpoint_spans(text: bytes, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Endpoints, leftmost first and not overlapping; of two that begin together the named one. Each stretch of letters is
    looked at once, so time grows with the text."""
    out, at, named = [], 0, pattern.search(text)
    urls = scheme_ends(text)
    url = next(urls, None)
    while True:
        if named and named.start() < at:
            named = pattern.search(text, at)
        found = None
        while url:
            start, slashes = url
            scheme = SCHEME.search(text, max(start, at), slashes - 1) if slashes > at else None
            rest = AFTER_SCHEME.match(text, slashes + 2) if scheme else None
            if rest:
                found = scheme.start(), rest.end()
                break
            url = next(urls, None)
        if not named and not found:
            return out
        span = named.span() if named and (not found or named.start() <= found[0]) else found
        out.append(span)
        at = span[1]


def weak_spans(text: bytes, lower: bytes, at: int) -> list[tuple[int, int]]:
    kind, _, words, pattern = WEAK[at]
    if kind == "part_secret":
        if b"1" * 20 not in text.translate(TOKEN_RUN):
            return []
        return [m.span() for m in pattern.finditer(text) if all(x.search(m[0]) for x in MIXED)]
    if not any(w in lower for w in words):
        return []
    return endpoint_spans(text, pattern) if kind == "part_endpoint" else [m.span() for m in pattern.finditer(text)]


def parts_of(text: str) -> list[tuple]:
    """(kind, role, start, end, scope) of all strong and weak parts; a weak one inside a strong one is left out, and so
    are all weak ones of a text that has no complementary parts at all."""
    data = text.encode("latin-1", "replace")
    lower = data.lower()
    strong = base_spans(data, lower)
    found = [(k, ROLE[KINDS[k]], a, b) for a, k, b in strong]
    begins, furthest = [x[0] for x in strong], list(accumulate((x[2] for x in strong), max))
    for at, (kind, role, _, _) in enumerate(WEAK):
        for a, b in weak_spans(data, lower, at):
            before = bisect_left(begins, b)
            if not before or furthest[before - 1] <= a:
                found.append((KINDS.index(kind), role, a, b))
    roles = {x[1] for x in found}
    if "secret" not in roles or len(roles) < 2 or not any(x[0] > 2 for x in found):
        return [(*x, 0) for x in found if x[0] <= 2]
    breaks = [m.start() for m in SCOPE.finditer(data)]
    out, scope = [], 0
    for x in sorted(found, key=lambda x: (x[2], x[0])):
        while scope < len(breaks) and breaks[scope] < x[2]:
            scope += 1
        out.append((*x, scope))
    return out


def with_parts(documents: DataFrame, key: str, parts: str) -> DataFrame:
    """All columns of documents, and under the two names the text's hash (null if it has no weak parts) and its parts."""
    at = documents.columns.index("text")
    names = ("kind", "role", "start", "end", "scope")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.string() if n == "role" else pa.int32()) for n in names]))
        for batch in sliced(batches):
            found_parts, keys = [], []
            for text in strings(batch.column(at)):
                found = parts_of(text)
                found_parts.append([dict(zip(names, x, strict=True)) for x in found])
                digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest() if any(x[0] > 2 for x in found) else None
                keys.append(digest)
            yield batch.append_column(key, pa.array(keys, pa.string())).append_column(parts, pa.array(found_parts, kind))

    added = [T.StructField(key, T.StringType()), T.StructField(parts, T._parse_datatype_string(PART))]
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *added]))


def linked_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(_text_key, _linked): the weak parts of each distinct text that have a complementary part within reach, in the
    same scope. An id or endpoint needs a secret; a secret needs an id or endpoint."""
    texts = found.where("_text_key is not null").select("_text_key", "_parts").dropDuplicates(["_text_key"])
    part = texts.select("_text_key", F.explode("_parts").alias("p")).select(
        "_text_key", *(F.col(f"p.{c}").alias(c) for c in ("kind", "role", "start", "end", "scope"))
    )
    bucket = lambda c: F.floor(F.greatest(c, F.lit(0)) / reach)
    secrets = part.where("role = 'secret'").select(
        "_text_key", "scope", F.struct("kind", "start", "end").alias("s"),
        F.explode(F.sequence(bucket(F.col("start") - reach), bucket(F.col("end") + reach))).alias("bucket"),
    )
    others = part.where("role <> 'secret'").select(
        "_text_key", "scope", F.struct("kind", "start", "end").alias("o"),
        F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bucket"),
    )
    near = secrets.join(others.hint("merge"), ["_text_key", "scope", "bucket"]).where(
        (F.col("s.start") <= F.col("o.end") + reach) & (F.col("o.start") <= F.col("s.end") + reach)
    )
    linked = near.select("_text_key", F.explode(F.array("s", "o")).alias("x")).where(F.col("x.kind") > 2).distinct()
    return linked.groupBy("_text_key").agg(F.collect_list("x").alias("_linked"))


def with_spans(found: DataFrame, linked: DataFrame, key: str, parts: str, spans: str) -> DataFrame:
    """Adds spans, an array of (start, kind, end): base spans and linked weak parts, in order. `linked` is a written table;
    it goes to all tasks if it is counted small, else rows are shuffled, those without weak parts by any other key."""
    if linked.count() <= LINKED_BOUND:
        joined = found.join(F.broadcast(linked.withColumnRenamed("_text_key", key)), key, "left")
    else:
        dealt = fresh(found, "_dealt")[0]
        rows = found.withColumn(dealt, F.coalesce(key, F.concat(F.lit("-"), F.xxhash64(*found.columns[:2]).cast("string"))))
        joined = rows.join(linked.withColumnRenamed("_text_key", dealt).hint("merge"), dealt, "left")
    both = F.concat(
        F.transform(F.filter(parts, lambda p: p["kind"] <= 2), lambda p: F.struct(p["start"], p["kind"], p["end"])),
        F.coalesce(
            F.transform("_linked", lambda p: F.struct(p["start"], p["kind"], p["end"])),
            F.array().cast("array<struct<start:int,kind:int,end:int>>"),
        ),
    )
    return joined.select(*found.columns, F.array_sort(both).alias(spans))


def joined(spans: str, base_only: bool):
    kind = F.transform(
        F.filter(spans, lambda s: s["kind"] <= 2) if base_only else F.col(spans),
        lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"]),
    )
    return F.array_join(kind, ",")


def find_secrets(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end) of every document. A null text is empty;
    repeated rows are scanned once each; other columns are ignored. Texts are read once: their parts are written out."""
    found = cut(with_parts(documents.select("doc_id", "text"), "_text_key", "_parts").drop("text"))
    linked = cut(linked_parts(found, reach))
    scanned = with_spans(found, linked, "_text_key", "_parts", "_spans")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)),
        F.sha2(joined("_spans", True), 256).alias("base_sha256"),
        joined("_spans", False).alias("spans"),
    )


def mask(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """The documents with each secret (linked ones too) replaced by its kind in angle brackets; overlapping spans are
    one, named by the first. n_chars, where there is one, follows the new text. Texts are written once with their parts, so
    that no task finds parts and masks too: it would hold two Python workers, and they live on."""
    key, parts, spans = fresh(documents, "_text_key", "_parts", "_spans")
    found = cut(with_parts(documents, key, parts))
    linked = cut(linked_parts(found.select(F.col(key).alias("_text_key"), F.col(parts).alias("_parts")), reach))
    scanned = with_spans(found, linked, key, parts, spans).select(*documents.columns, spans)
    at, last = scanned.columns.index("text"), len(scanned.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(batch.column(last).to_pylist()):
                if found:
                    texts[i] = masked(texts[i], [(s["start"], s["kind"], s["end"]) for s in found])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    changed = scanned.mapInArrow(run, scanned.schema)
    if "n_chars" in documents.columns:
        n = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", n.cast(documents.schema["n_chars"].dataType))
    return changed.select(*documents.columns)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _spans_sql(name: str, kind: int, pattern: str, keep: str = "true") -> str:
    """Spans of a pattern: between its matches lie the pieces that splitting by it leaves."""
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT r, {kind} AS kind, a, a + length(m) AS b, m FROM (
        SELECT r, m[i] AS m, list_sum(list_transform(pc[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS pc FROM docs)))
    WHERE {keep})"""


_SOURCES = [x.decode() for x in (ASSIGN.pattern, ACCESS.pattern, HEX.pattern, *(w[3].pattern for w in WEAK))]
_ASSIGN, _ACCESS, _HEX, _ID, _SECRET, _ENDPOINT = _SOURCES
#: The same scan in DuckDB's dialect, on the same patterns; two letters that only Unicode folds to ASCII are taken out.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, replace(replace(coalesce(text, ''), 'K', '?'), 'ſ', '?') AS t FROM documents),
{_spans_sql("k0", 0, _ASSIGN, "length(regexp_extract(m, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 8")},
{_spans_sql("k1", 1, _ACCESS, "length(m) >= 16")},
{_spans_sql("k2", 2, _HEX)},
{_spans_sql("k3", 3, "(?i)" + _ID)},
{_spans_sql("k4", 4, _SECRET, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')")},
{_spans_sql("k5", 5, "(?i)" + _ENDPOINT)},
{_spans_sql("blank", 9, SCOPE.pattern.decode())},
strong AS (FROM k0 UNION ALL FROM k1 UNION ALL FROM k2),
weak AS (SELECT * FROM (FROM k3 UNION ALL FROM k4 UNION ALL FROM k5) w WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.r = w.r AND s.a < w.b AND w.a < s.b)),
parts AS (SELECT p.r, p.kind, p.a, p.b, ['secret', 'id', 'secret', 'id', 'secret', 'endpoint'][p.kind + 1] AS role, count(blank.a) AS scope
    FROM (FROM strong UNION ALL FROM weak) p LEFT JOIN blank ON blank.r = p.r AND blank.a < p.a GROUP BY ALL),
pairs AS (SELECT s.r, s.kind AS sk, s.a AS sa, s.b AS sb, o.kind AS k, o.a, o.b FROM parts s JOIN parts o ON s.r = o.r AND s.scope = o.scope AND s.role = 'secret' AND o.role <> 'secret'
    AND s.a <= o.b + {REACH} AND o.a <= s.b + {REACH}),
found AS (SELECT r, kind, a, b FROM strong UNION SELECT r, sk, sa, sb FROM pairs WHERE sk > 2 UNION SELECT r, k, a, b FROM pairs WHERE k > 2),
named AS (SELECT *, {list(KINDS)}[kind + 1] || ':' || a || ':' || b AS s FROM found),
joined AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(s, ',' ORDER BY a, kind, b) FILTER (kind <= 2) AS base, string_agg(s, ',' ORDER BY a, kind, b) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (r)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; columns of any other name are kept as they are."""
    return mask(docs)
