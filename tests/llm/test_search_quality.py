"""Ranked lexical search and quality rules against plain Python versions, held-out labels and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from foliant.llm import lexical_search, quality
from foliant.llm.common import table

SF = "/root/testdata/sf0.001"
CLASHING = ("rank", "score", "item", "merge", "n", "terms", "docs", "words", "held_out", "fold", "quality", "_most")
DOCS = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
MORE = ["x"] * len(CLASHING)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, words = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in docs:
            m = 75 + (25 * c.total() * n_docs) // max(1, words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scores += [(-s, d is None, d)] if s else []
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, n=3, **kw):
    d = spark.createDataFrame([(*x, *MORE) for x in docs], DOCS).repartition(n)
    i = spark.createDataFrame([(*x, "x", "y") for x in items], "item_id long, text string, doc_id string, score string")
    return sorted(map(tuple, lexical_search.search(d, i, **kw).collect()), key=str)


def test_search_with_ties_and_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünïcode", "ÉTÉ", "x_y", "42"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(200)]
    docs += [(i, "w1 w2 W3 w1, w1") for i in range(300, 360)]  # sixty tied copies
    docs += [(None, "w1 w2"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (400, None), (401, ""), (402, "... !"), (403, "w5 " * 500_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(90)]
    items += [(1, "w1 w1 w1 W1"), (1, "w1 w1 w1 W1"), (1, "w2"), (None, "w3 w4"), (91, None), (92, ""), (93, "absent"), (94, "?!")]
    want = plain_search(docs, items)
    assert searched(spark, docs, items) == searched(spark, docs, items, n=7) == want and len(want) > 1000
    assert searched(spark, docs, items, group_words=40) == want  # many passes
    assert searched(spark, docs, []) == searched(spark, [], items) == searched(spark, [(1, None)], items) == []
    assert searched(spark, docs, items, k=3) == plain_search(docs, items, 3)


def test_tiles_bound_their_sums():
    rng = random.Random(5)
    weights = [{t: rng.choice([0, 1, 7, 100, 1000]) for t in rng.sample(range(50), 20)} for _ in range(6)]
    for most, width in ((50, 4), (130, 50), (10**9, 7)):
        pieces, total = lexical_search.columns(weights, most, width), np.zeros((6, 50))
        for at, w in pieces:
            assert len(at) <= width and len(set(at)) == len(at) and (w.sum(axis=1) <= most).all()
            total[:, at] += w
        assert (total == [[of.get(t, 0) for t in range(50)] for of in weights]).all()
    assert lexical_search.MOST_WEIGHT * lexical_search.MOST_IMPACT <= 2**53
    assert int(lexical_search.impacts(np.array([10**9]), np.array([1]), 1, 10**12)[0]) < lexical_search.MOST_IMPACT


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def counted(rows):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]


def test_counts_equal_plain_ones_and_odd_rows(spark):
    rng = random.Random(7)
    odd = ["", None, "a b c d\x85e", "x\r\ny\r\nx\r\n \n\t\n", "& é😀 <b> " * 20, "same line\n" * 60, "w " * 700_000 + "end", "\x1c\x1d a"]
    odd += [" ".join(rng.choices("abc", k=rng.randrange(2, 90))) for _ in range(60)] + ["long" * 600_000 + " tail", "a a a", "a b"]
    texts = [r.text for r in table(spark, SF, "documents").select("text").collect()] + odd
    docs = spark.createDataFrame([(i if i % 9 else None, t, *MORE) for i, t in enumerate(texts)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_rules(docs, none).collect()
    assert sorted(counted(got)) == sorted(map(plain_counts, texts))
    assert all(r.score is None and r.kept == (not r.base_failed) for r in got)  # without labels the rules decide
    assert quality.quality_rules(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 200)] + [(3, 0, "x"), (3, 1, "x"), (None, 1, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    assert quality.quality_rules(docs, labels).count() == len(texts)


def plain_features(text):
    w, out = re.findall(r"[^\x20\x09-\x0D]+", text), Counter()
    hashed = [xxhash.xxh3_64_intdigest(x.encode()) for x in w]
    for kind, (of, size, plus) in enumerate([(hashed, 1, 0), (hashed, 2, 0), ([ord(c) for c in text], 2, 1), ([ord(c) for c in text], 4, 1)]):
        grams = []
        for i in range(len(of) - size + 1):
            h = 0
            for x in of[i : i + size]:
                h = (h * quality.BASE + x + plus) % 2**64
            grams.append(h)
        at = quality.bucket(np.array(grams, np.uint64), kind).tolist()
        for b in at:
            out[b] += quality.GAIN / len(at)
    return out


def test_model_is_the_optimum_and_finds_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels)
    import zlib

    label = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(zlib.crc32(str(r.doc_id).encode()) % 5, label[r.doc_id], plain_features(r.text)) for r in docs.collect() if r.doc_id in label and not plain_counts(r.text)[-1]]
    learned = [(y, x) for f, y, x in rows if f not in (quality.HELD_OUT, quality.CALIBRATES)]

    def steepest(weights, intercept):
        """Of the mean loss, over plainly computed features."""
        slope = quality.PENALTY * weights
        for y, x in learned:
            p = 1 / (1 + math.exp(-(intercept + sum(weights[b] * v for b, v in x.items()))))
            for b, v in x.items():
                slope[b] += (p - y) * v / len(learned)
        return np.abs(slope).max()

    assert steepest(model.weights, model.intercept) < 0.05 * steepest(np.zeros(len(model.weights)), 0.0)
    got = quality.judge(docs, model).where("held_out and not base_failed").join(labels, "doc_id").collect()
    wrong = [r for r in got if r.kept != bool(r.quality)]
    assert len(got) > 50 and len(wrong) <= len(got) // 20
