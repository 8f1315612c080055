import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from wayfold.llm import token_alignment as T
from wayfold.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OURS = T.Pair(open(A).read(), open(B, "rb").read())
TA, TB = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
TA.encode_special_tokens = True
SYMBOL = {s: k for k, s in enumerate(byte_symbols())}


def sides(text):
    """Ids and byte strings of both sides, of the whole text."""
    a = TA.encode(" " + text, add_special_tokens=False).ids
    b = TB.encode(text)
    return a, [bytes(SYMBOL[c] for c in TA.id_to_token(i)) for i in a], b, [bytes([int(TB.id_to_piece(i)[3:5], 16)]) if TB.is_byte(i) else TB.id_to_piece(i).replace("▁", " ").encode() for i in b]


def plainly(text):
    """(n_a, n_b, groups, links) by byte offsets."""
    if not text:
        return 0, 0, [], []
    a, xs, b, ys = sides(text)
    if b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
        return 0, 0, [], []
    ea, eb = np.cumsum([len(x) for x in xs]).tolist(), np.cumsum([len(y) for y in ys]).tolist()
    both = sorted(set(ea) & set(eb))
    groups, links, before = [], [], 0
    for e in both:
        groups.append(",".join(str(i) for i, x in zip(a, ea, strict=True) if before < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, eb, strict=True) if before < x <= e))
        links += [(i, j) for i, x in zip(a, ea, strict=True) if x == e for j, y in zip(b, eb, strict=True) if y == e]
        before = e
    return len(a), len(b), groups, links


def check(text):
    n_a, n_b, n_groups, groups, la, lb, ln = OURS.aligned(text)
    want = plainly(text)
    assert (n_a, n_b, groups.decode()) == (want[0], want[1], ";".join(want[2])), repr(text)
    assert n_groups == len(want[2])
    assert Counter(dict(zip(zip(la.tolist(), lb.tolist(), strict=True), ln.tolist(), strict=True))) == Counter(want[3])


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_any_text(text):
    check(text)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", " ", "▁", "a", "the", "The", "'s", "ing", "é", "日本", "\U0001f600", "12", "!!", "<s>", "<|endoftext|>", "<0x0A>", "<unk>", "ﬁ", "é", "\x00", "ha"]), max_size=24).map("".join))
def test_pieces(text):
    check(text)


def test_long_words_and_texts():
    rng = random.Random(3)
    for t in ("a" * 5000, " " * 3000, "ab " * 2000, "x\n" * 1000, "日" * 3000):
        check(t) if len(t) < 4000 else OURS.aligned(t)
    for _ in range(200):
        check("".join(rng.choice("abcdehilnorstu ") for _ in range(rng.randrange(1, 80))))


def test_transducer_is_the_same_from_the_start_again():
    small = T.Transducer(OURS.a_bytes, OURS.b_bytes, most=3)
    for text in ("Unbelievable antidisestablishmentarianism", "naïve façade – “quotes”", "x" * 50):
        a, b = OURS.tokens(text)
        assert small.groups(a, b) == OURS.transducer.groups(a, b)
    with pytest.raises(ValueError):
        T.Transducer([b"ab"], [b"ac"]).groups([0], [0])


def rows_of(docs):
    texts = [(i, *plainly(t or "")) for i, t in docs]
    count = Counter(x for *_, links in texts for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        (
            (i, n_a, n_b, len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for i, n_a, n_b, g, links in texts
        ),
        key=repr,
    )


def test_query(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "The cat's pyjamas, unbelievable!"), (4, "The cats sat.  On\tthe mat \n"), (4, "The cat sat."), (3, "The cat's pyjamas, unbelievable!"), (None, "né é 日本 \U0001f600"), (6, "a▁b"), (7, "the " * 3000), (8, "<|endoftext|> <s>")]
    docs += [(10 + i, " ".join(random.Random(i).choice(["the", "cat", "un", "believ", "able", "tion", "zqx", "The", "cats"]) for _ in range(20))) for i in range(40)]
    at = str(tmp_path / "sf")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, pair string, n_links int")
    df.write.parquet(f"{at}/documents.parquet")
    want = rows_of(docs)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = T.op13_token_alignment(spark, at)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == want
    # the way of many pairs
    links = T.aligned(df, A, B).withColumnRenamed("id", "doc_id").drop("groups")
    links.write.parquet(f"{at}/links")
    links = spark.read.parquet(f"{at}/links")
    far = T.scored(links, most_broadcast=0)
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
    assert sorted((tuple(r[c] for c in cols[:-1]) for r in far.collect()), key=repr) == sorted((w[:-1] for w in want), key=repr)
    assert T.scored(links.limit(0)).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect() if len(r.text or "") < 3000]
    got = {(r.doc_id, r.n_a, r.n_b, r.groups.decode() if isinstance(r.groups, bytearray) else r.groups) for r in T.aligned(spark.createDataFrame(docs, "doc_id long, text string"), A, B).withColumnRenamed("id", "doc_id").collect()}
    assert got == {(i, w[0], w[1], ";".join(w[2])) for i, t in docs for w in [plainly(t or "")]}


def test_other_tokenizers_are_not_parted():
    spec = json.loads(open(A).read())
    spec["pre_tokenizer"]["use_regex"] = False
    assert OURS.parted and not OURS._parted(spec)
