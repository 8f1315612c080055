import numpy as np
import pytest

from wayfold.llm import blocks as B
from wayfold.llm import embedding_dedup as E


def brute(rows, threshold=0.9):
    """Links and components over all pairs of vectors of one length, in double precision."""
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    label, links = list(range(len(rows))), dict.fromkeys(range(len(rows)), 0)
    for dim in {len(rows[k][1]) for k in ok}:
        of = [k for k in ok if len(rows[k][1]) == dim]
        x = np.array([np.array(rows[k][1], np.float32).astype(float) for k in of])
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        for k, n in zip(of, near.sum(axis=1), strict=True):
            links[k] = int(n)
        left, at = set(range(len(of))), []
        while left:
            at = [left.pop()]
            root = of[at[0]]
            while at:
                next_ = [int(b) for b in np.flatnonzero(near[at.pop()]) if b in left]
                left.difference_update(next_)
                at += next_
                for b in next_:
                    label[of[b]] = root
    least = {}
    for (i, _), z in zip(rows, label, strict=True):
        if i is not None:
            least[z] = min(i, least.get(z, i))
    return [(i, links[k], least.get(label[k])) for k, (i, _) in enumerate(rows)]


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, node int, w string").repartition(3)
    return sorted(((r.id, r.n_links, r.component_id) for r in E.embedding_near_dedup(df, **options).collect()), key=str)


def assert_close(got, expected, rate=0.9):
    expected = sorted(expected, key=str)
    pairs, found = sum(n for _, n, _ in expected), sum(n for _, n, _ in got)
    assert pairs and len(got) == len(expected) and [g[0] for g in got] == [e[0] for e in expected]
    assert rate * pairs <= found <= pairs, (found, pairs)
    for g, e in zip(got, expected, strict=True):
        assert g[1] <= e[1] and (e[2] is None or g[2] >= e[2])
    return found / pairs


@pytest.mark.parametrize("block", [4096, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i * 2, rng.normal(size=8).tolist()) for i in range(150)]
    for k in range(5):
        rows += [(1000 + k * 100 + j, (np.array(rows[k][1]) + rng.normal(size=8) * 0.12).tolist()) for j in range(12)]
    rows += [(2001 + j, (3.0 * np.array(rows[0][1]) + rng.normal(size=8) * 0.02).tolist()) for j in range(60)]
    rows += [(5000 + j, rows[7][1]) for j in range(9)] + [(14, rows[7][1])]
    rows += [(-1, None), (-2, [0.0] * 8), (-3, [None] + [1.0] * 7), (-4, [float("nan")] * 8), (-5, [float("inf")] + [1.0] * 7), (-7, []), (None, [0.0] * 8), (None, rows[7][1]), (None, [1e-30] * 8), (-8, [3e30] * 8)]
    rows += [(-6, [1.0] * 3), (-9, [2.0] * 3), (-10, [1.0, -1.0, 0.0]), (-11, [1.0]), (-12, [-1.0]), (-13, [5.0])]
    got, expected = result(spark, rows), brute(rows)
    assert_close(got, expected)
    assert np.mean([g == e for g, e in zip(got, sorted(expected, key=str), strict=True)]) > 0.9
    assert {(-6, 1, -9), (-9, 1, -9), (-10, 0, -10), (-13, 1, -13), (-11, 1, -13), (-12, 0, -12)} <= set(got)


def test_empty_and_kept(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0]), (5, [1.0, 0.0]), (4, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert {(r.id, r.n_links, r.component_id, r.kept) for r in E.embedding_near_dedup(df).collect()} == {(1, 0, 1, True), (2, 0, 2, True), (4, 1, 4, True), (5, 1, 4, False)}
    assert E.embedding_near_dedup(df.limit(0)).count() == 0
    assert E.embedding_near_dedup(df.where("vec_id < 3")).count() == 2


def planted(rng, n, dim, common, clusters, size, spread=0.35):
    """Vectors with a common component (times the noise's length), and clusters of close ones among them."""
    x = rng.normal(size=(n, dim)) / np.sqrt(dim)
    for c in range(clusters):
        x[c * size : (c + 1) * size] = x[c * size] + rng.normal(size=(size, dim)) * spread / np.sqrt(dim)
    x[:, 0] += common
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("common", [0, 1, 2, 3, 5])
def test_recall_with_a_common_component(spark, common):
    rows = planted(np.random.default_rng(common), 1500, 64, common, 60, 5)
    assert assert_close(result(spark, rows), brute(rows)) >= 0.9


def test_recall_on_tight_clusters_of_mixed_lengths(spark):
    rng = np.random.default_rng(8)
    rows = planted(rng, 3000, 48, 0.5, 40, 30, 0.2) + [(5000 + i, v) for i, v in planted(rng, 700, 32, 0, 20, 10, 0.3)] + [(9000 + i, v) for i, v in planted(rng, 6, 5, 0, 1, 6, 0.01)]
    assert assert_close(result(spark, rows), brute(rows)) >= 0.95
    indexes = E.fit_all([np.array(v) / np.linalg.norm(v) for i, v in rows if i < 5000], 3000, 0.9, 0.97)
    assert indexes.of[48][1].width >= 4  # the tables are in use here, not one bucket for all


def test_six_vectors_that_are_all_close(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(64) + rng.normal(size=64) * 0.03).tolist()) for i in range(6)]
    assert result(spark, rows) == [(i, 5, 0) for i in range(6)]


def test_recall_on_the_table(spark):
    """The table has hardly a pair at the threshold, so a fifth of its vectors come again, turned to cosines from 0.9 on, some in clusters."""
    rng = np.random.default_rng(4)
    x = np.array([np.array(r.embedding, float) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.vstack([x[:1000], np.repeat(x[1000:1010], 20, axis=0)])
    z = rng.normal(size=y.shape)
    z -= (z * y).sum(axis=1, keepdims=True) * y
    at = rng.uniform(0.9, 1, (len(y), 1))
    all_ = np.vstack([x, at * y + np.sqrt(1 - at**2) * z / np.linalg.norm(z, axis=1, keepdims=True)])
    rows = [(i, v.tolist()) for i, v in enumerate(all_)]
    assert assert_close(result(spark, rows), brute(rows)) >= 0.95


def test_codes_are_balanced_and_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64)) * np.linspace(2, 0.5, 64) + 1.0
    x /= np.linalg.norm(x, axis=1)[:, None]
    for n in (6000, 1_000_000):
        index = E.fit(x[:3000], n, 0.9, 0.97)
        assert index.width >= 4
        words, own, flipped = index.coded(x)
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        assert np.abs(bits[:3000].mean(axis=0) - 0.5).max() < 0.12
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
        words2, own2, flipped2 = index.coded(y)
        met = B.retrieved(own, flipped, own2, flipped2).any(axis=1) & (np.bitwise_count(words ^ words2).sum(axis=1) <= index.radius)
        assert met.mean() > 0.94


def test_sample_is_what_hashes_lowest(spark):
    from pyspark.sql import functions as F

    from wayfold.llm import embedding_dedup as M

    nodes = spark.range(20_000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.array(F.col("id").cast("double")).alias("v")).repartition(50).cache()
    for sample in (1, 50, 5000, 30_000):
        want = [r.v for r in nodes.orderBy("h1", "h2").limit(sample).collect()]
        assert M._lowest(nodes, 20_000, sample).to_pylist() == want
    assert M._lowest(nodes.limit(0), 0, 10).to_pylist() == []
