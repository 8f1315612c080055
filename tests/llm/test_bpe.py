import hashlib
import random
import time

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = B.Tokenizer(open(PATH).read())


def check(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    got = OURS.encode(text)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == ids, text
    assert OURS.decode(got) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs"]), max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "Ab", "the", "ing", "tion", "'s", "'LL", " ", "\n", "\x85", "　", "Σ", "ΑΣ", "İ", "é", "ß", "<|endoftext|>", "<|startoftext|>", "<|", "12", "½", "!!", "?!", "日本", "²", "\xb9", "\xb7", "_", "ª", "À", "ÿ", "ŉ", "ſ", "Ⅷ", "\x1f", "\xad", "\U0001f600", "ha", "ll", "\x00", "\x1c"]), max_size=40).map("".join))
def test_pieces(text):
    check(text)


def test_long_runs():
    rng = random.Random(1)
    for t in ("", "a" * 3000, "ab" * 2000, "!" * 999, "thththth" * 400, "x" * 20_000):
        check(t)
    for _ in range(300):
        check("".join(rng.choice("abcdehilnorstu") for _ in range(rng.randrange(1, 60))))
    began = time.time()
    OURS.encode("q" * 50_000)
    assert time.time() - began < 20


def test_every_token_is_its_own_path():
    for s, i in list(OURS.vocab.items())[512::37]:
        if s.endswith("</w>"):
            w = s[:-4]
            data = bytes(OURS.symbols.index(c) for c in w)
            try:
                text = data.decode()
            except UnicodeDecodeError:
                continue
            check(text)


def test_query(spark):
    texts = [None, "", "  ", "Hello WORLD, it's 2024", "né é", "<|endoftext|>x", "word " * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids string")
    got = B.digests(docs).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        ids = THEIRS.encode(texts[r.id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert B.digests(docs.limit(0)).count() == 0
    apart = B.decode(B.encode(docs, PATH), PATH).collect()
    assert sorted(map(tuple, apart), key=str) == sorted(map(tuple, B.encode(docs, PATH, decoded=True).collect()), key=str)
