"""Texts, pages and conversations made to slow operators down, to make hashes collide, or to hide what counts."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, html_extraction, near_duplicates, packing, secrets, toxicity
from foliant.llm.common import distinct_spans, word_hashes


def thue_morse(n):
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    text = "".join("ab"[x] for x in word)
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize(
    "text",
    ["url " + "http" * 250_000, "http://" * 150_000, "url=" * 250_000, "s3" * 500_000, "url https:" * 100_000, "url " + ":" * 10**6, "password=" * 110_000,
     "aB3" * 350_000, "AKIA" * 250_000, "0a" * 500_000, "client_id=" * 100_000, ("token" + " " * 1000) * 1000, "\n " * 500_000, "endpoint:http://" * 60_000,
     "password=abcdefgh1 user=bobby aB3dEfGhIjKlMnOpQrStUv9 https://a.b.cdef\n\n" * 14_000],
    ids=range(15),
)
def test_a_megabyte_of_parts_takes_little_time(text):
    began = time.process_time()
    secrets.parts_of(text)
    assert time.process_time() - began < 3


def test_endpoints_are_those_of_one_pattern():
    both = re.compile(
        secrets.WEAK[2][3].pattern + rb"|((?:jdbc:|postgres|mysql|mongodb|redis|amqp|s3|https?)[a-z+:]*://[^ \t\n\r\f\v\"'<>]{4,})", re.IGNORECASE
    )
    rng = random.Random(1)
    pieces = [b"http", b"HTTPS", b"s3", b"S3", b"jdbc:", b"mysql", b"url", b"host", b"=", b":", b" ", b"://", b"/", b"a", b"abcd", b"x.y", b"9", b"\n", b"'", b"+", b":80", b":/"]
    for _ in range(30_000):
        text = b"".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert secrets.endpoint_spans(text, secrets.WEAK[2][3]) == [m.span() for m in both.finditer(text)]


def test_colliding_words_are_told_apart():
    a, b = thue_morse(1024)
    words = [a, b, "x", a, b, a + "x"]
    codes = np.frombuffer(" ".join(words).encode() + b" ", np.uint8)
    ends = np.flatnonzero(codes == 32)
    which, first = distinct_spans(codes, np.append(0, ends[:-1] + 1), ends)
    assert [words[first[w]] for w in which] == words and len(set(which.tolist())) == 4
    h, _ = word_hashes([" ".join(words).encode()])
    assert len(set(h.tolist())) == 4 and h[0] == h[3] and h[1] == h[4]


def test_colliding_texts_keep_their_rows_and_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    a, b = thue_morse(1024)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(str(path))
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.class_id for r in near_duplicates.ngram_jaccard_join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert near_duplicates.stage(spark, docs, "").count() == 4
    import zlib

    for r in packing.pack_documents(docs, path).collect():
        ids = [*plain.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_remembered_words_of_one_hash_have_their_own_ratios():
    a, b = thue_morse(64)
    model = toxicity.ToxicityModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    model.raw([a, b])
    assert {len(w) for w in model.known} == {64} and len(model.known) == 2


def pages(spark, make, n=30):
    rows = [(i, f"http://h.example/{i}", make(i)) for i in range(n)]
    return {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def told(i, n=40):
    return " ".join(f"w{i * 7 + k * k % 97}x{i}" for k in range(n))


@pytest.mark.parametrize("words", [6, 80])
def test_columns_that_differ_in_a_number_are_not_one_node(spark, words):
    side = " ".join(f"same{k}" for k in range(words))
    got = pages(spark, lambda i: f"<div class='row'><div class='col-md-8'><p>{told(i)}</p></div><div class='col-md-4'><p>{side}</p></div></div>")
    assert got == {i: told(i) for i in range(30)}


@pytest.mark.parametrize("most", [7, 14])
def test_comments_go_however_many_there_are(spark, most):
    def make(i):
        said = "".join(f"<div class='comment' id='comment-{i * 20 + k}'><p>{told(1000 + i * 20 + k, 9 + k)}</p></div>" for k in range(i % most + 1))
        return f"<article><h1>Title {i} x</h1><p>{told(i)}</p></article><div class='comments'>{said}</div>"

    got = pages(spark, make, 14)
    assert got == {i: f"Title {i} x\n{told(i)}" for i in range(14)}


def test_boilerplate_larger_than_the_article_goes(spark):
    big = " ".join(f"boiler{k}" for k in range(200))
    got = pages(spark, lambda i: f"<div class='text'><p>{told(i, 25)}</p></div><div class='box'><p>{big}</p></div>")
    assert got == {i: told(i, 25) for i in range(30)}


def test_entropy_decides_against_purpose(spark):
    got = pages(spark, lambda i: f"<article><p>{told(i)}</p><div class='text'><p>All rights are ours and ours alone</p></div></article><div class='y'><p>{told(i + 99)}</p></div>")
    assert got == {i: f"{told(i)}\n{told(i + 99)}" for i in range(30)}


def test_every_example_of_a_long_conversation_has_its_whole_context(spark):
    rows = [("c", i, "assistant" if i % 2 else "user", f"turn {i} <") for i in range(130)]
    made = chat.examples(chat.format_turns(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))).collect()
    assert len(made) == 65
    for r in made:
        said = [(chat.unescape(m[1]), chat.unescape(m[2])) for m in chat.TURN.finditer(r.text)]
        assert said == [(role, text) for _, _, role, text in rows[: r.turn_no + 1]] and chat.unescape(r.text[r.loss_start : r.loss_end]) == rows[r.turn_no][3]
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert {r.block for r in chat.examples(formatted, 10).collect()} == set(range(13)) and {r.block for r in chat.examples(formatted, None).collect()} == {0}


def test_a_long_conversation_is_spelled_out_whole(spark):
    n = 1100
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(n)]
    made = chat.examples(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    (r,) = made.where(f"turn_no = {n - 1}").collect()
    assert [chat.unescape(m[2]) for m in chat.TURN.finditer(r.text)] == [text for *_, text in rows]
    held = made.where("loss_start is not null").agg(F.sum(F.length("text"))).first()[0]
    (digest,) = chat.read_back(made).collect()
    assert digest.formatted_chars == held and digest.n_turns == n and digest.n_examples == n // 2
