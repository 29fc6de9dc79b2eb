import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from foliant.llm import chat, decontamination, exact_topk, html_extraction, language, near_duplicates, packing, secrets, toxicity, url_filter
from foliant.llm.common import table
from foliant.llm.html_dom import blocks
from foliant.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
CLASHING = ("set_key", "_score", "_spans", "_parts", "_items", "_text_key", "_kept_key", "_kept_id", "_n", "_n_words", "_dealt", "_k", "_total", "_hot", "_cold", "block", "node")
TEXT = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
ODD = [
    (i, t, "en", None, len(t or ""), *(["x"] * len(CLASHING)))
    for i, t in [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "w " * 50_000), (4, "😀 é\n\t"), (5, "one text of six words here"), (5, "another text with seven words in it")]
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, TEXT)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, name):
    from oracle import connect, differences

    assert differences(spark, connect(SF), queries()[name], oracle_sql()[name], SF) == []


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_jaccard_join_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x].doc_id)
                root[b] = a
    expected = {r.doc_id: (rows[find(i)].doc_id, links[i]) for i, r in enumerate(rows)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.ngram_jaccard_join(docs).collect()}
    assert got == expected


def test_jaccard_join_of_odd_rows(spark, odd):
    got = near_duplicates.ngram_jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    assert near_duplicates.ngram_jaccard_join(odd.limit(0)).count() == 0
    kept = near_duplicates.stage(spark, odd, SF)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted({(r[0] or 0, r[1] or "") for r in ODD})
    assert near_duplicates.stage(spark, odd.limit(0), SF).count() == 0


def test_forest_and_blocks_find_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 200).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(200) < 0.05, rng.integers(0, 2**60, 200).astype(np.uint64), base)) for _ in range(30)]
    got = near_duplicates.similar(sets, near_duplicates.Fraction("0.8"))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and both * 10 >= 8 * (len(a) + len(b) - both))


def base_digest(text):
    text = text or ""
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    return hashlib.sha256(joined.encode()).hexdigest()


def test_secrets_equal_brute_force_and_link_parts(spark, odd):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(base_digest(texts[r.doc_id]) == r.base_sha256 for r in secrets.find_secrets(docs).collect())
    token = "aB3dEfGhIjKlMnOpQrStUv9"
    df = spark.createDataFrame(
        [(1, f"x client_id = abcd99 and {token} ok\n\nuser: bob4"), (2, token), (3, "client_id = abcd99"), (4, f"user: bob4 {'z ' * 200}{token}"), (5, "é😀 ToKeN = 'abcdefgh' " + "0a" * 20)],
        "doc_id long, text string",
    )
    got = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    assert got[1] == "part_id:2:20,part_secret:25:48" and got[2] == got[3] == got[4] == ""
    masked = {r.doc_id: r.text for r in secrets.mask(df).collect()}
    assert masked[1].startswith("x <part_id> and <part_secret> ok") and masked[5] == "é😀 <assign>' <hex>" and masked[2] == token
    assert secrets.find_secrets(odd).count() == len(ODD) and secrets.mask(odd.limit(0)).count() == 0


def test_long_parts_link_at_any_position(spark):
    token, texts = "aB3dEfGhIjKlMnOpQrStUv9", []
    for length in (5, 300, 900):
        for at in range(0, 420, 30):
            for gap in (10, 199, 200, 201):
                far = "https://" + "a." * (length // 2)
                texts += [" " * at + far + " " * gap + token, " " * at + token + " " * gap + far]
    want = []
    for text in texts:
        parts = secrets.parts_of(text)
        near = lambda a, b: a[2] <= b[3] + secrets.REACH and b[2] <= a[3] + secrets.REACH
        pairs = [(a, b) for a in parts for b in parts if a[1] == "secret" != b[1] and a[4] == b[4] and near(a, b)]
        want.append(",".join(f"{secrets.KINDS[x[0]]}:{x[2]}:{x[3]}" for x in sorted({x for p in pairs for x in p}, key=lambda x: (x[2], x[0]))))
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in got} == dict(enumerate(want)) and any(want) and not all(want)


def extracted(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extraction.extract(df, **kw).collect()}


def story(i):
    return " ".join(f"w{i * 7 + k * k % 97}x{i}" for k in range(40))


def test_copies_of_a_page_count_once(spark):
    page = "<div class='x'><p>Only text of this host, long enough to be the largest branch</p></div><footer>{}</footer>"
    rows = [(i, f"http://h/{i}", page.format(i % 3)) for i in range(40)]
    rows += [(i, f"http://k/{i}", page.format(0) if i < 90 else f"<div class='x'><p>{story(i)}</p></div>") for i in range(50, 92)]
    got = extracted(spark, rows)
    assert {got[i] for i in [*range(40), *range(50, 90)]} == {"Only text of this host, long enough to be the largest branch"} and got[91] == story(91)


def test_entropy_decides_beside_presentation(spark):
    # a notice without telltale class in the article goes; text in a part of it that may be a notice stays, if it differs
    inside = "<article><div class='x'><p>Read our terms</p></div><p>{0}</p><section class='discussion'><p>More {0}</p></section></article>"
    beside = "<div class='text'><p>{0}</p></div><div class='y'><p>Long {0}</p></div><div class='z'><p>Same line</p></div>"
    rows = [(i, f"http://h{i % 2}/{i}", (inside, beside)[i % 2].format(story(i))) for i in range(40)]
    got = extracted(spark, rows)
    assert got == {i: f"{story(i)}\nLong {story(i)}" if i % 2 else f"{story(i)}\nMore {story(i)}" for i in range(40)}
    # menus and footers of other words on each page still go, for what they are
    framed = "<nav><a href=x>{0}</a></nav><article><p>{1}</p></article><footer>{0}</footer>"
    assert extracted(spark, [(i, "http://h/", framed.format(story(900 + i), story(i))) for i in range(30)]) == {i: story(i) for i in range(30)}


def test_extraction_equals_a_plain_style_tree(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(5000 + i, f"http://s{i % 3}/", f"<div class=t><p>{story(i)}</p></div><div class=u>Subscribe to all news of s{i % 3}</div><ul><li><a href=x>A {i % 4}</a></ul>") for i in range(60)]
    rows += [(9000, None, None), (9001, "x", ""), (9002, "http://s0/", "<p>" * 50 + "deep")]
    parsed, copies, tree = {}, {}, {}
    for page_id, url, html in rows:
        host, found = html_extraction.host_of(url or ""), blocks(html or "")
        parsed[page_id] = host, found
        nodes = {}
        for path, text, linked in found:
            node = nodes.setdefault(path, [[], 0, 0, [p[-1] if p else "" for p, _, _ in found if p[:-1] == path[:-1]]])
            node[0].append(text)
            node[1] += len(text)
            node[2] += min(linked, len(text))
        if nodes:
            values = {path: least_of_words(" ".join(node[0]), 1)[0].tolist() for path, node in nodes.items()}
            most = max(nodes, key=lambda p: nodes[p][1])
            columns = (
                [html_extraction.node_key(host, p) for p in nodes], [html_extraction.key_of(*n[3]) for n in nodes.values()],
                [html_extraction.purpose(p) for p in nodes], [n[1] for n in nodes.values()], [n[2] for n in nodes.values()], sum(values.values(), []),
            )
            copies.setdefault((host, least_of_words(" ".join(nodes[most][0]), 5)), []).append((columns, nodes, values))
    for (host, _), same in copies.items():
        _, nodes, values = min(same, key=lambda x: x[0])
        for path, node in nodes.items():
            tree.setdefault((host, path), []).append((node, values[path]))
    removed = set()
    for (host, path), seen in tree.items():
        m = len(seen)

        def entropy(values, usual, m=m):
            share = [n / m for n in Counter(values).values()]
            return ((m * -sum(p * np.log(p) for p in share) / np.log(m) if m > 1 else m * usual) + 4 * usual) / (m + 4)

        content = np.mean([entropy([v[i] for _, v in seen], 0.65) for i in range(html_extraction.FEATURES)])
        layout = entropy([tuple(node[3]) for node, _ in seen], 0.5)
        links = sum(node[2] for node, _ in seen) / sum(node[1] for node, _ in seen)
        if content * (0.1 + 0.25 * layout + 0.55 * html_extraction.purpose(path) - 0.3 * links) < 0.28:
            removed.add((host, path))
    want = {i: "\n".join(t for p, t, _ in found if (host, p) not in removed) for i, (host, found) in parsed.items()}
    assert extracted(spark, rows) == want and extracted(spark, rows, bound=0) == want
    assert removed and any(want.values())


def least_of_words(text, width):
    """Features of a text's words (width 1), or its least shingle."""
    from foliant.llm.common import binary_words, shingle_hashes, word_hashes

    h, n = word_hashes([binary_words(text)])
    return html_extraction.features(h, n) if width == 1 else int(min(shingle_hashes(h, n, width)[0], default=0))


def test_no_page_takes_long(spark):
    import time

    pages = ["<a " * 400_000, '<a "' * 300_001 + ">", "<div>" * 200_000 + "</p>" * 200_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<iframe>" * 100_000, "<p>x" * 200_000, "<" * 1_000_000, "<!--" * 100_000]
    began = time.time()
    for page in pages:
        blocks(page)
    assert time.time() - began < 30


def test_text_of_unusual_elements_is_text():
    got = [t for _, t, _ in blocks("<article>a<noscript>b</noscript><svg><text>c</text></svg><math>d</math><object>e</object><canvas>f</canvas><script>no</script><style>no</style></article>")]
    assert " ".join(got) == "a b c d e f"


def test_top_k_is_exact_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    base = [rng.normal(size=6).tolist() for _ in range(40)]
    rows = [(i, base[i % 40] if i % 3 else base[0]) for i in range(200)] + [(1000, None), (1050, [float("nan")] * 6), (1100, [None] * 6), (1150, [1e30] * 6)]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    good = [(i, [int(x) * 256 if abs(x) > 2**60 else int(np.floor(256 * x)) for x in v]) for i, v in rows if v and v[0] is not None and v[0] == v[0]]
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:5]
            assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(max(min(-s, 2**63 - 1), -(2**63)), i) for s, i in best]
    assert exact_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    far = spark.createDataFrame([(0, [300000.0]), (1, [400000.0]), (2, [500000.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in sorted(exact_topk.top_k(far).collect(), key=lambda r: r.rank)] == [(2, 9830400000000000), (1, 7864320000000000)]
    numbers = [0, 1, -1, 255, 256, -256, 2**63, -(2**63) - 5, 2**200]
    assert sorted(numbers) == sorted(numbers, key=exact_topk.ordered)


def test_main_text(spark):
    page = """<html><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">ok</div><article><h1>T &amp; x</h1><p>One
     two<br>three <b>bold<p>Second &eacute;</p><div class=comments><p>nice</p></div><aside>ad</aside></article><footer>&copy; x</footer></body></html>"""
    assert extracted(spark, [(1, "http://a/b", page)]) == {1: "T & x\nOne two three bold\nSecond é"}
    assert blocks("a < b <p title='x>y'>c") == [((), "a < b", 0), (("p",), "c", 0)]
    same = "<div class='x'><p>Every page says so</p></div><div class='y'><p>Only here {}</p></div>"
    got = extracted(spark, [(i, f"http://h/{i}", same.format(story(i))) for i in range(20)] + [(90, None, None), (91, "", ""), (91, "", "")])
    assert got[3] == f"Only here {story(3)}" and got[90] == got[91] == "" and len(got) == 22
    empty = spark.createDataFrame([], "page_id long, url string, html string, nodes string")
    assert html_extraction.extract(empty).count() == 0


def test_best_fit_decreasing_equals_one_by_one():
    random.seed(1)
    for window in (16, 64):
        for _ in range(20):
            lengths = [random.choice([1, 3, window // 2, random.randint(1, window)]) for _ in range(random.randint(1, 300))]
            room = []
            for x in sorted(lengths, reverse=True):
                fits = [i for i, r in enumerate(room) if r >= x]
                best = min(fits, key=lambda i: room[i]) if fits else len(room)
                room[best : best + 1] = [(room[best] if fits else window) - x]
            filled, seen = Counter(), Counter()
            for length, a, b, first, offset in packing.plan_best_fit(Counter(lengths), window):
                for k in range(b - a):
                    assert filled[first + k] == offset
                    filled[first + k] += length
                    seen[length] += 1
            assert seen == Counter(lengths) and sorted(room) == sorted(window - x for x in filled.values())


def test_packing_holds_every_id_once(spark, odd):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    tricky = ["it's 'sup don't'll \n\n x", "  'll '' 's\n's\t\tq 12² Ⅷ½ 中文。テスト", "<|endoftext|> hi", "a<|endoftext|><|endoftext|>b", "\x1c a b  c", "x'", "\r\n \r\n"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(10 + i, x) for i, x in enumerate(tricky)], "doc_id long, text string"))
    got = packing.pack_documents(docs, path).collect()
    for doc_id, text in [(3, ODD[4][1]), *[(10 + i, x) for i, x in enumerate(tricky)]]:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc_id)
        assert sum(n for _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in mine)
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_decontamination_of_odd_rows_and_many_blocks(spark, odd):
    items = table(spark, SF, "benchmark")
    docs = table(spark, SF, "documents").select("doc_id", "text")
    one = {tuple(r) for r in decontamination.decontaminate(docs, items).collect()}
    many = decontamination.digest_hits(decontamination.with_hits(docs, items, decontamination.NAMES, block_words=500))
    assert {tuple(r) for r in many.collect()} == one
    short = spark.createDataFrame([(1, "w w"), (2, None), (None, "a b")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.decontaminate(odd, short).collect()}
    assert got[3] == (50_000, 50_000, 1) and got[1] == (0, 0, 0) and got[None] == (2, 2, 1)
    assert decontamination.decontaminate(odd, short.limit(0)).where("contaminated").count() == 0
    assert decontamination.stage(spark, odd, SF).columns == odd.columns and decontamination.stage(spark, odd.limit(0), SF).count() == 0


def test_a_task_has_one_python_step(spark, odd):
    items = table(spark, SF, "benchmark")
    steps = (
        lambda rows: secrets.stage(spark, rows, SF),
        lambda rows: decontamination.with_hits(rows, items, decontamination.NAMES, block_words=500),
    )
    for step in steps:
        out = step(odd.select("doc_id", "text"))
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert out.count() == odd.count()


def test_languages_of_held_out_documents(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.learn(docs.where(language.fold(4) != 2))
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"
    assert language.learn(docs.limit(0)).predict(["abc", ""])[0] == ["und", "und"]


def test_url_rules_and_models(spark):
    rows = [(1, "http://a.example.net/en/x"), (2, "https://NET/x"), (3, "http://a.net?q"), (4, "http://b.example.com/de/"), (5, "x"), (6, None), (7, "ftp://m.org/fr/q#z"), (7, "ftp://m.org/fr/q#z")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 8 and by[1][3:] == ("example.net/en/", "allow") and by[2][1:4] == ("net", "/x", "net/") and by[3][1:4] == ("a.net", "", None)
    assert by[4][4] == "block" and by[5][1:3] == ("", "") and by[7][3] == "org/fr/"
    train = [(i, f"http://good{i}.org/fr/read{i}") for i in range(60)] + [(100 + i, f"http://spam{i}.net/win{i}") for i in range(60)]
    more = [(500, "http://good777.com/fr/read9"), (501, "http://spam777.com/win8")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(train + more, "page_id long, url string")).collect()}
    assert got[500] == "allow" and got[501] == "block"


def test_toxicity_of_held_out_documents(spark, odd):
    labels, docs = table(spark, "/root/testdata/sf0.1", "labels"), table(spark, "/root/testdata/sf0.1", "documents")
    model = toxicity.learn(docs, labels)
    rows = toxicity.toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.85 and hit / sum(r.toxic for r in rows) > 0.7
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(odd, model).collect()}[1] == 0
    nothing = toxicity.learn(docs.limit(0), labels)
    assert nothing.raw(["a b"]).tolist() == [0.0] and nothing.score(["a"])[0] < 0.5


def test_toxicity_keeps_rare_ngrams_of_a_large_corpus(spark):
    from pyspark.sql import functions as F

    ordinary = " ".join(f"ordinary{a}words{b}" for a in "abcdefghij" for b in "klmnopqrst")
    rows = spark.range(0, 30_000, 1, 4).select(F.when(F.col("id") % 3000 == 0, ordinary + " zqxj").otherwise(ordinary).alias("text"), (F.col("id") % 3000 == 0).cast("int").alias("_toxic"))
    model = toxicity.fit(rows)
    # ten toxic uses tell the word from one that nobody has used
    assert model.raw(["zqxj zqxj"])[0] > model.raw(["vbnm vbnm"])[0] + 0.1


def test_toxicity_by_join_equals_toxicity_by_broadcast(spark, odd):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    small, large = toxicity.learn(docs, labels), toxicity.learn(docs, labels, bound=0)
    assert isinstance(small, toxicity.ToxicityModel) and isinstance(large, toxicity.ToxicityTables)
    assert large.cut == pytest.approx(small.cut) and large.slope == pytest.approx(small.slope)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        a, b = (sorted(tuple(r) for r in toxicity.scored(df, m, raw=True).selectExpr("coalesce(doc_id, 0) as doc_id", "_score").collect()) for m in (small, large))
        assert [x[0] for x in a] == [x[0] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b], abs=1e-6)
        a, b = (sorted((r.doc_id or 0, r.predicted) for r in toxicity.toxicity(df, m).collect()) for m in (small, large))
        assert a == b


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", r"\b <turn x> </turn> \\l"), (1, 0, "user", None), (1, 2, "user", "bye"), (2, None, None, "x"), (2, None, None, "x"), (None, 0, "assistant", ""), (None, 1, "user", "y")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"<{i}>") for i in range(20)]
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for turns in (64, 3):
        made = chat.examples(formatted, turns)
        got = {r.conv_id: r for r in chat.read_back(made).collect()}
        assert chat.read_back(made).count() == 5 and set(got) == {1, 2, 3, None}
        assert got[1].n_turns == 3 and got[1].loss_chars == len(rows[0][3]) and got[2].n_examples == 0 and got[3].n_examples == 10
        assert got[1].loss_sha256 == hashlib.sha256(rows[0][3].encode()).hexdigest()
        assert got[3].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == 3).encode()).hexdigest()
    replies = [r for r in chat.examples(formatted).where("conv_id = 3").collect() if r.loss_start is not None]
    # each reply has all turns before it as context, and only its own text has loss
    for r in replies:
        assert chat.unescape(r.text[r.loss_start : r.loss_end]) == f"<{r.turn_no}>" and len(chat.TURN.findall(r.text)) == r.turn_no + 1
    assert len(replies) == 10 and chat.read_back(chat.examples(formatted.limit(0))).count() == 0


def test_components(spark):
    from foliant.llm.graph import components

    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("z", "y"), ("q", "q")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "x"}
    hub = [("m", f"n{i:04}") for i in range(600)] + [(f"p{i}", "n0007") for i in range(400)] + [("a", "p3")]
    got = {r.node: r.root for r in components(spark.createDataFrame(hub, "a string, b string")).collect()}
    assert set(got.values()) == {"a"} and len(got) == 1002
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
