import random
import re

import xxhash
from pyspark.sql import functions as F

from wayfold.llm import simhash as S
from wayfold.llm.components import connected_components


def plain(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {x: find(x) for x in nodes}


def test_fingerprint_runs(monkeypatch):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = "".join(rng.choice(["Ab", "é", "\x0b", " ", "\n", "x\xa0y", "Q"]) for _ in range(n))
        expected = plain(text)
        assert S.fingerprint(text.encode()) == expected
        whole = S._runs
        monkeypatch.setattr(S, "_runs", lambda t, o: whole(t, o, 7))
        assert S.fingerprint(text.encode()) == expected
        monkeypatch.setattr(S, "_runs", whole)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(200, 5000)] + [(5, 5), (None, 3), (140, 139)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{j: 7 for j in range(200, 5000)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["on", "the", "er", "tion", "ly", "be"]) + str(rng.randrange(99)) for _ in range(300)) for _ in range(6)]
    texts = [None, "", " \n", "a", "A", "a b", *base, *base[:3]]
    for t in base[:3]:
        for _ in range(40):
            w = t.split()
            w[rng.randrange(300)] = "zz"
            texts.append(" ".join(w))
    rows = [(i * 3, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a", "x", 1), (9, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    fps = [plain(t) for _, t, *_ in rows]
    comp = components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    expected = sorted(((i, f - ((f >> 63) << 64), least.get(comp[f])) for (i, *_), f in zip(rows, fps, strict=True)), key=str)
    for pairwise in (64, 2):
        monkeypatch.setattr(S, "PAIRWISE", pairwise)
        assert sorted(map(tuple, S.near_duplicates(docs).collect()), key=str) == expected
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_with_shared_ids_and_clashing_names(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(5, own(1), "a"), (7, own(1), "b"), (5, own(2), "c"), (9, own(2), "d"), (None, own(3), "e"), (None, own(4), "f"), (None, own(4), "f"), (3, own(4), "g"), (8, own(5), "h"), (8, own(5), "h"), (10, None, "i"), (11, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("wanted", F.lit(1)).withColumn("root", F.lit(2))
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.key, r.doc_id) for r in got.collect()) == [("a", 5), ("c", 5), ("e", None), ("g", 3), ("h", 8), ("i", 10)]
    assert S.one_of_each(docs.limit(0)).count() == 0
