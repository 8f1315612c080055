import random

import public_tokenizers

from wayfold.llm import token_counts as T


def greedy(word, initial, following):
    at, n, pieces = 0, 0, initial
    while at < len(word):
        size = next((k for k in range(min(len(word) - at, 60), 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 0
        at, n, pieces = at + size, n + 1, following
    return n


def test_small_vocabularies_against_greedy():
    rng = random.Random(1)
    for _ in range(300):
        made = lambda n: {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(n)}
        initial, following = made(rng.randrange(1, 9)), made(rng.randrange(0, 9))
        m = T.Matcher(initial, following)
        for _ in range(60):
            w = bytes(rng.choice(b"abcd" if rng.random() < 0.05 else b"abc") for _ in range(rng.randrange(1, 12)))
            assert m.count(w) == greedy(w, initial, following), (w, initial, following)


def test_the_whole_vocabulary():
    initial, following = T.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    m, a, b = T.Matcher(initial, following), set(initial), set(following)
    words = ["the", "unbelievable", "Étion", "çouelle", "日本語", "a" * 5000, "xq" * 999, "\U0001f600", "can't", "über-x", "\x00", "2024"]
    assert [m.count(w.encode()) for w in words] == [greedy(w.encode(), a, b) for w in words]


def test_query(spark):
    texts = [None, "", " \n\t", "the cat", "the cat \U00012345 the", "word " * 3000, "the cat"]
    docs = spark.createDataFrame([(i if i else None, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, id string")
    vocabulary = ([b"th", b"cat", b"word"], [b"e", b"\xc2\xa0", b"cat"])
    got = sorted(((r.n_words, r.n_tokens, r.n_unknown) for r in T.token_counts(docs, vocabulary).collect()))
    assert got == sorted([(0, 0, 0)] * 3 + [(2, 3, 0)] * 2 + [(3, 4 + 1 + 2, 1), (3000, 3000, 0)])
    assert T.token_counts(docs.limit(0), vocabulary).count() == 0
    assert {r.n_unknown for r in T.token_counts(docs.where("text = 'the cat'"), ([], [])).collect()} == {2}


def test_table_against_greedy(spark):
    initial, following = map(set, T.pieces_of(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in T.op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        found = [greedy(w, initial, following) for w in (r.text or "").encode().split()]
        assert got[r.doc_id] == (len(found), sum(max(n, 1) for n in found), found.count(0))
