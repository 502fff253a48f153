import random

import pytest

from vigilark.llm import tokens as K

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def enc():
    return K.Encoder(K.read_ranks(P.path("byte_bpe_50k.tiktoken")))


@pytest.fixture(scope="module")
def peer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_pattern_is_the_public_one():
    assert K.PATTERN == P.PATTERN


def test_random_texts(enc, peer):
    rnd = random.Random(1)
    alphabet = list("abAB12  \n\n\t'sll.,-_あ漢é́٣½²\x1c\x1d\x85\xa0 ᠎​﻿\U0001f600") + ["<|endoftext|>", "'re", "'VE", "  "]
    for _ in range(4000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        assert enc.encode(s) == peer(s), s
        assert enc.count(s) == len(enc.encode(s))


@pytest.mark.parametrize("text", ["a" * 20000, "あ" * 5000, "ab" * 5000, " " * 3000, "acgt" * 20000, "x" + " \n" * 2000, "".join(random.Random(2).choice("acgt") for _ in range(20000))])
def test_long_pretokens(enc, peer, text):
    assert enc.encode(text) == peer(text)


def test_caches_change_nothing(enc, monkeypatch):
    texts = ["the carrier and the  channel", "word " * 50, "a b c d e f g"]
    want = [enc.encode(t) for t in texts]
    monkeypatch.setattr(K, "CACHE_ENTRIES", 2)
    small = K.Encoder(enc.ranks)
    assert [small.encode(t) for t in texts] == want == [small.encode(t) for t in texts]


def test_rank_queue():
    q, rnd, seen = K.RankQueue(), random.Random(3), []
    for i in range(500):
        r = rnd.choice([rnd.randrange(50_000), rnd.randrange(300)])
        q.push(r, i)
        seen.append((r, i))
    out = []
    while q:
        rank, places = q.pop()
        out += [(rank, p) for p in places]
    assert out == sorted(seen)


def test_frames(spark, enc):
    long = "seq " + "acgt" * 30_000
    rows = [(1, "A first lens."), (2, ""), (3, None), (4, "   "), (1, "A first lens."), (5, long), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS id")
    got = K.token_ids(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, enc.encode(t)) for i, t in rows)
    counts = {r.doc_id: r.n_tokens for r in K.token_counts(df, "doc_id", "text").collect()}
    assert counts == {i: len(enc.encode(t)) for i, t in rows}
    assert K.token_ids(df.limit(0), "doc_id", "text").count() == 0
    assert dict(K.token_ids(df, "doc_id", "text").dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
