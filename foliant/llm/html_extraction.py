"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of elements by their presentation (tag, class, id, role).
Each node with text has three measures over the host's pages. Content: the entropy of its words' features, which are the
least values of some hash functions over all words of the node on a page; pages that say the same share them. Presentation:
the entropy of the ways in which pages lay out the branch it belongs to, since articles differ in that and templates
don't. Purpose: what its elements say they are for, and how much of it is links. Importance is content times a sum of the
others, in which layout counts by purpose: reader comments, whose number and words vary as much as articles do, aren't
saved by that. Branches of low importance are removed from every page, and what is left is its text.

The tree is counted over distinct pages (of near copies on a host mostly one counts, by signatures of all their text) as sums by node and feature, with
partial aggregates, so a host with a third of all pages is no hot group; texts are not shuffled. Nodes to remove are few,
since pages of a host share them; they are sent to all tasks if their number is within a bound, else joined to the pages.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import binary_words, cut, multipliers, segments, shingle_hashes, sliced, strings, table, word_hashes
from foliant.llm.graph import join_split
from foliant.llm.html_dom import blocks

#: Branches of less importance go.
LEAST_IMPORTANCE = 0.28
#: What a branch's presentation adds beside its content: as it is, by layout entropy, by purpose, by share of links.
BASE, BY_LAYOUT, BY_PURPOSE, BY_LINKS = 0.1, 0.25, 0.55, -0.3
#: Content and layout of a branch seen on no page, and the number of pages that this counts as.
USUAL_CONTENT, USUAL_LAYOUT, USUAL_PAGES = 0.65, 0.5, 4
#: Purpose of a branch by its elements.
ARTICLE, PLAIN, CHROME, HIDDEN = 1.0, 0.5, 0.0, -0.5
#: Nodes to remove up to this number are sent to all tasks (8 bytes each).
NODES_BOUND = 2_000_000
#: Hash functions whose least values over a branch's words are its features.
FEATURES = 16
#: Of these so many, over all shingles of a page, make its signature.
SIGNS = 8
#: Elements, and words in class, id or role, of what is no main text.
CHROME_TAGS = {
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head", "select", "datalist",
}
CHROME_WORDS = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|footer|side-?bar|aside|ads?|adverts?|advertisement|"
    r"sponsor(?:ed)?|promo|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|comments?|"
    r"disqus|replies|widget|toolbar|pagination|pager|contentinfo|complementary)(?:[^a-z]|$)"
)
#: Words that also articles use for parts of their own.
DOUBTFUL_WORDS = re.compile(
    r"(?:^|[^a-z])(?:header|banner|notice|social|related|recommended|discussion|search|alert|copyright|legal)(?:[^a-z]|$)"
)
ARTICLE_WORDS = re.compile(r"(?:^|[^a-z])(?:article|main|post|entry|story|content|text|body)(?:[^a-z]|$)")


@lru_cache(1 << 16)
def purpose(path: tuple[str, ...]) -> float:
    """What a branch is for by its elements: no main text from the first element on that says so. A header inside an
    article is the article's own; a doubtful word makes part of an article plain, and other branches chrome."""
    value = PLAIN
    for element in path:
        tag, names = re.match(r"([^.#@!]*)(.*)", element, re.DOTALL).groups()
        if "!hidden" in names:
            return HIDDEN
        if tag in CHROME_TAGS and not (tag == "header" and value == ARTICLE) or names and CHROME_WORDS.search(names):
            return CHROME
        if names and DOUBTFUL_WORDS.search(names):
            if value != ARTICLE:
                return CHROME
            value = PLAIN
        elif tag in ("article", "main") or names and tag != "body" and ARTICLE_WORDS.search(names):
            value = ARTICLE
    return value


def key_of(*parts: str) -> int:
    data = "\x00".join(parts).encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def node_key(host: str, path: tuple[str, ...]) -> int:
    return key_of(host, *path)


def host_of(url: str) -> str:
    return re.split(r"[/?#]", url.split("://", 1)[-1], maxsplit=1)[0].lower()


def least_values(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least value of each text, 0 for a text without any."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.minimum.reduceat(values, segments(counts)[some])
    return out


def features(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text, given by hashes of its words, the least value of each hash function (texts by FEATURES)."""
    out = [least_values(words * a ^ (words >> np.uint64(29)), counts) for a in multipliers(FEATURES)]
    return (np.stack(out, axis=1) >> np.uint64(8)).astype(np.uint32).view(np.int32)


SEEN = (
    "host long, content long, nodes array<long>, layouts array<long>, purposes array<float>, sizes array<int>, "
    "links array<int>, features array<int>"
)


def _branches(url: str, html: str) -> tuple[str, dict[tuple, list]]:
    """Host, and by path its texts, characters, characters inside links, layout of the branch it belongs to."""
    below: dict[tuple, list[str]] = {}
    found: dict[tuple, list] = {}
    for path, text, linked in blocks(html):
        below.setdefault(path[:-1], []).append(path[-1] if path else "")
        branch = found.setdefault(path, [[], 0, 0])
        branch[0].append(text)
        branch[1] += len(text)
        branch[2] += min(linked, len(text))
    layout = {parent: key_of(*names) for parent, names in below.items()}
    return host_of(url), {path: [*branch, layout[path[:-1]]] for path, branch in found.items()}


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEEN of each page with text: `content` tells pages of a host apart: it is made of the least values of some hash functions
    over the five-word shingles of its branches, which pages of similarity J share with chance J to the power of SIGNS. Branches
    of fewer than five words, such as page numbers, make no difference where there are others."""
    for batch in sliced(batches, 200):
        pages = [_branches(url, html) for url, html in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True)]
        pages = [page for page in pages if page[1]]
        texts = [binary_words(" ".join(branch[0])) for _, found in pages for branch in found.values()]
        words, counts = word_hashes(texts)
        least = features(words, counts)
        shingles, n = shingle_hashes(words, counts, 5)
        page = np.repeat(np.arange(len(pages)), [len(found) for _, found in pages])
        longest = np.zeros(len(pages), np.int64)
        np.maximum.at(longest, page, counts)
        used = (counts >= 5) | (longest[page] < 5)
        shingles, n = shingles[np.repeat(used, n)], np.where(used, n, 0)
        signed = features(shingles, np.bincount(page, n, len(pages)).astype(np.int64))[:, :SIGNS]
        rows, at = [], 0
        for (host, found), signature in zip(pages, signed, strict=True):
            size = [branch[1] for branch in found.values()]
            content = int.from_bytes(hashlib.blake2b(signature.tobytes(), digest_size=8).digest(), "little", signed=True)
            rows.append(
                (
                    key_of(host), content, [node_key(host, path) for path in found], [b[3] for b in found.values()],
                    [purpose(path) for path in found], size, [b[2] for b in found.values()], least[at : at + len(size)].ravel(),
                )
            )
            at += len(size)
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.int64(), *(pa.list_(k) for k in (pa.int64(), pa.int64(), pa.float32(), pa.int32(), pa.int32(), pa.int32())))
        names = [x.split()[0] for x in SEEN.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def importance(m: Column, layouts: Column, contents: Column, size: Column, linked: Column, purpose: Column) -> Column:
    """From the number of pages, sum of n ln n of layouts and of all features, characters, characters inside links and
    purpose. Entropies are to the base of the number of pages: 0 if all pages are alike, 1 if all differ."""
    entropy = lambda s, usual: (m * F.when(m > 1, 1 - s / (m * F.log(m))).otherwise(usual) + USUAL_PAGES * usual) / (m + USUAL_PAGES)
    content, layout = entropy(contents / FEATURES, USUAL_CONTENT), entropy(layouts, USUAL_LAYOUT)
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), purpose + 0.5))
    return content * (BASE + BY_LAYOUT * layout * trust + BY_PURPOSE * purpose + BY_LINKS * linked / size)


def style_tree(pages: DataFrame) -> DataFrame:
    """(node, importance) of all branches that have text. Near copies of a page mostly count once."""
    columns = ("nodes", "layouts", "purposes", "sizes", "links", "features")
    seen = pages.select("url", "html").mapInArrow(_seen, SEEN)
    distinct = seen.groupBy("host", "content").agg(F.min(F.struct(*columns)).alias("r"))
    at = lambda c, i: F.element_at(f"r.{c}", i + 1)
    branch = lambda i: F.struct(
        at("nodes", i).alias("node"), at("layouts", i).alias("layout"), at("purposes", i).alias("purpose"),
        at("sizes", i).alias("size"), at("links", i).alias("linked"), F.slice("r.features", i * FEATURES + 1, FEATURES).alias("features"),
    )
    each = distinct.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("r.nodes") - 1), branch)).alias("b")).select("b.*")
    # Item -1 is the layout, the others are the features.
    items = each.select("node", "purpose", "size", "linked", F.posexplode(F.concat(F.array("layout"), F.col("features").cast("array<long>"))))
    counted = items.groupBy("node", "pos", "col").agg(
        F.count("*").alias("n"), F.max("purpose").alias("purpose"),
        *(F.sum(F.when(F.col("pos") == 0, F.col(c))).alias(c) for c in ("size", "linked")),
    )
    of = lambda which, c: F.sum(F.when(which, c).otherwise(0))
    layout, weight = F.col("pos") == 0, F.col("n") * F.log("n")
    nodes = counted.groupBy("node").agg(
        of(layout, F.col("n")).alias("m"), of(layout, weight).alias("layouts"), of(~layout, weight).alias("contents"),
        F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.max("purpose").alias("purpose"),
    )
    return nodes.select("node", importance(*map(F.col, ("m", "layouts", "contents", "size", "linked", "purpose"))).alias("importance"))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, bound: int = NODES_BOUND) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    All branches with text are in the style tree of their host; a page gives those that it does not find unimportant,
    whole and in page order. Scripts, styles, templates and markup are no text. Null html is empty; repeated rows are read
    once each; a null url is a host of its own; other columns are ignored; an empty table gives no rows.
    """
    low = cut(style_tree(pages)).where(F.col("importance") < LEAST_IMPORTANCE).select("node")
    rows, removed = pages.select("page_id", "url", "html"), None
    if low.count() <= bound:
        removed = pages.sparkSession.sparkContext.broadcast(frozenset(low.toPandas()["node"].tolist()))
        rows = rows.withColumn("low", F.lit(None).cast("array<long>"))
    else:
        rows = with_low_nodes(rows, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = removed.value if removed else frozenset()
        for batch in sliced(batches, 200):
            texts = []
            for url, html, own in zip(strings(batch.column(1)), strings(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                host, gone = host_of(url), everywhere if own is None else set(own)
                texts.append("\n".join(text for path, text, _ in blocks(html) if node_key(host, path) not in gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, EXTRACTED)


def with_low_nodes(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Adds low, the nodes to remove of each page's shape (the nodes it has); for any number of them."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            given = zip(strings(batch.column(1)), strings(batch.column(2)), strict=True)
            nodes = [sorted(node_key(host, path) for path in found) for host, found in (_branches(u, h) for u, h in given)]
            yield batch.append_column("nodes", pa.array(nodes, pa.list_(pa.int64())))

    keyed = rows.mapInArrow(shapes, "page_id long, url string, html string, nodes array<long>").withColumn("shape", F.xxhash64("nodes"))
    kinds = cut(keyed.groupBy("shape").agg(F.count("*").alias("n"), F.any_value("nodes").alias("nodes")))
    gone = (
        kinds.select("shape", F.explode("nodes").alias("node")).join(low.hint("merge"), "node")
        .groupBy("shape").agg(F.collect_set("node").alias("low"))
    )
    side = cut(kinds.drop("nodes").join(gone.hint("merge"), "shape", "left"))
    return join_split(keyed.drop("nodes"), side, "shape", "n", rows.count()).select("page_id", "url", "html", "low")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
