import random
import re

import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm.test_simhash import components
from wayfold.llm import blocks as B
from wayfold.llm import similar_texts as D


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def changed(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 120, 400]))) for _ in range(60)]
    texts = [None, "", " \n", "a", "A", "a b", "a b c d e", "A b c  d\ne", *base, *base[:4]]
    for t in base[:45]:
        texts += [changed(rng, t, rng.choice([1, 2, 4, 8, 12])) for _ in range(4)]
    texts += [changed(rng, base[0], 2) for _ in range(60)]  # one large group
    return texts


def test_recall_against_brute_force(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    near = lambda a, b: a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if near(a, b)]
    assert len(pairs) > 300
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    got = {r.id: r.component_id for r in D.similar_groups(docs).collect()}
    want = components(range(len(texts)), lambda a, b: near(a, b) or not sets[a] | sets[b])
    assert got == want
    kept = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert kept == set(want.values())
    assert D.similar_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("rounds", "crowded", "block"), [(0, (0, 0), 4096), (8, (1, 1), 16), (3, (1, 0), 4096)])
def test_crowded_and_large_buckets(spark, monkeypatch, rounds, crowded, block):
    monkeypatch.setattr(D, "ROUNDS", rounds)
    monkeypatch.setattr(D, "CROWDED", crowded)
    monkeypatch.setattr(B, "BLOCK", block)
    test_recall_against_brute_force(spark)


@pytest.mark.parametrize("n", [60, 2000, 300_000, 10**9])
def test_blocks_find_pairs_at_the_similarity(n):
    """Sets of 200 shingles of which 4 in 5 are shared, by the blocks for tables of several sizes."""
    rng = np.random.default_rng(1)
    p, found = D.plan_blocks(n, 0.8), 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 222, np.uint64)
        a, b = (D.sums(s, p.bits)[None] for s in (np.sort(x[:200]), np.sort(x[22:])))
        met = B.retrieved(*B.keys(a, p.tables, p.width), *B.keys(b, p.tables, p.width)).any()
        found += bool(met) and bool(B.within(B.words(a), B.words(b), p.radius)[0, 0])
    assert found >= 282


def test_sets_do_not_depend_on_runs(monkeypatch):
    text = corpus()[9].encode()
    whole, runs = D.shingle_set(text, 5, D._words()), D._runs
    monkeypatch.setattr(D, "_runs", lambda t, o: runs(t, o, 30))
    assert (D.shingle_set(text, 5, D._words()) == whole).all() and len(whole) == len(shingles(text.decode()))
