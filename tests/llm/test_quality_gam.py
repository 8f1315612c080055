import zlib

import numpy as np

from wayfold.llm import quality_gam as G


def test_tables_learn_curves_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    x[:, 3] = 1.0  # one bin
    y = ((np.abs(x[:, 0] - 0.5) < 0.25) ^ (rng.random(4000) < 0.02)).astype(float)
    m = G.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    m = G.fit(x[:3000], y[:3000])
    assert (2, 1) in m.pairs and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    alone = G.fit(x[:3000], y[:3000], pairs=0)
    assert ((alone.score(x[3000:]) > 0.5) == y[3000:]).mean() < 0.7


def test_score_is_the_sum_of_the_tables():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.random((300, 5)), np.zeros((2, 5)), np.ones((2, 5)) * 9])
    m = G.fit(x[:250], ((x[:250, 0] > 0.4) ^ (x[:250, 1] > 0.6)).astype(float))
    plain = []
    for row in x:
        total = m.intercept
        for f in range(5):
            total += m.tables[f][sum(e <= row[f] for e in m.edges[f])]
        for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
            total += t[sum(e <= row[a] for e in m.pair_edges[a])][sum(e <= row[b] for e in m.pair_edges[b])]
        plain.append(1 / (1 + np.exp(-total)))
    assert m.pairs and np.allclose(m.score(x), plain)


def test_rows_that_share_an_id_count_once(spark):
    docs = spark.createDataFrame([(i, ("good word here. " if i % 2 else "### $$$ %%% ") * 9) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] * 2, "doc_id long, quality int")
    more = docs.unionByName(docs).unionByName(docs)
    a, b = G.train(docs, labels), G.train(more, labels)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))
    long = spark.createDataFrame([(1, "word " * 2_000_000)], "doc_id long, text string")
    assert 0 <= G.score(long, a).first().score <= 1


def test_trees():
    g, h = np.array([1.0, 1, -5, -5, 9, 9]), np.full(6, 100.0)
    t = G._tree(g, h, 3)
    assert (t[0] == t[1]) and (t[2] == t[3]) and (t[4] == t[5]) and len(set(t)) == 3
    best, gain = G._tree2(np.array([[9.0, -9], [-9, 9]]), np.full((2, 2), 50.0))
    assert gain > 0 and (np.sign(best) == [[1, -1], [-1, 1]]).all()
    assert (G._tree(np.zeros(1), np.ones(1), 3) == 0).all()


def test_constant_models():
    for y in ([], [1.0, 1.0], [0.0]):
        m = G.fit(np.zeros((len(y), len(G.FEATURES))), np.array(y))
        s = m.score(np.zeros((2, len(G.FEATURES))))
        assert ((s >= 0) & (s <= 1)).all() and (not y or (s[0] > 0.5) == (y[0] == 1))


def test_features():
    got = dict(zip(G.FEATURES, G.features("AB ab ab #x 12!\nAB ab ab #x 12!\n\né".encode()), strict=True))
    assert got["log_words"] == np.log(11) and got["twice_running"] == 2 / 11 and got["symbol_words"] == 2 / 11 and got["upper_words"] == 2 / 11
    assert got["distinct_words"] == 5 / 11 and got["top_word"] == 4 / 11 and got["distinct_triples"] == 6 / 9 and abs(got["repeated_lines"] - 1 / 3) < 1e-12
    assert G.features(None) == G.features(b" \n") == [0.0] * len(G.FEATURES)


def test_long_text_in_runs(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 97) for i in range(3000))
    whole = G.features(text)
    runs = G._runs
    monkeypatch.setattr(G, "_runs", lambda t, o: runs(t, o, 100))
    assert np.allclose(G.features(text)[:-3], whole[:-3], atol=2e-2) and G.features(text)[0] == whole[0]


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in G.op10_quality_gam(spark, base).collect()}
    assert len(got) == spark.read.parquet(f"{base}/documents.parquet").count()
    labels = spark.read.parquet(f"{base}/labels.parquet").collect()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_labels_that_are_held_out_dont_count(spark):
    docs = spark.createDataFrame([(i, ("good word here. " if i % 2 else "### $$$ %%% ") * 9, "x", 0) for i in range(200)] + [(None, None, "x", 0), (500, "", "x", 0), (500, "", "x", 0)], "doc_id long, text string, score string, y int")
    right = [(i, i % 2) for i in range(200)]
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in right] + [(None, 1), (3, None)]
    a, b = ([tuple(r) for r in G.score(docs, G.train(docs, spark.createDataFrame(x, "doc_id long, quality int"))).orderBy("id").collect()] for x in (right, wrong))
    assert a == b and len(a) == 203 and all(0 <= s <= 1 for _, s in a)
    assert G.score(docs.limit(0), G.Model()).count() == 0
    none = G.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in G.score(docs, none).collect()} == {0.5}
