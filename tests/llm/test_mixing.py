import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wayfold.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By rounds: what lies above a limit is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return got | {s: level * w[s] for s in open_}
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        open_ -= over
    return got


def corpus(seed=4):
    rng = random.Random(seed)
    rows = [(None, "a b c", "z", 1), (1, None, "b", 1), (2, "", None, 1), (3, " \n", "empty", 1), (4, "one", "tiny", 1), (5, "x y " * 40, "ä", 1), (5, "x y " * 40, "ä", 1)]
    for i in range(10, 400):
        rows.append((i, "\n".join(f"w{i}x{j}" for j in range(int(rng.paretovariate(1) * 4) % 900)), rng.choice(["hot"] * 9 + ["b", "a", None, "Z"]), 7))
    return rows


def test_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int").repartition(3)
    a, b = [], []
    for out in (a, b):
        r, p, slots = M.mix(docs, block=16)
        out += [tuple(x) for x in M.taken_words(r, p).select("id", "size", "source_size", "target", "taken").collect()]
    assert sorted(a, key=str) == sorted(b, key=str)
    size = [(i, len(WORD.findall(t or "")), s) for i, t, s, _ in rows]
    sizes = Counter()
    for _, n, s in size:
        sizes[s] += n
    expected = targets(sizes)
    by_size = {v: k for k, v in sizes.items()}
    assert sorted((str(x[0]), x[1]) for x in a) == sorted((str(i), n) for i, n, _ in size)
    taken = Counter()
    for _i, n, total, target, t in a:
        s = by_size[total]
        assert abs(target - expected[s]) < 1e-6 and 0 <= t <= 2 * n
        taken[s] += t
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 2 * 16, (s, taken[s], t)
    # what each document gives, counted anew word by word from the slots
    times = Counter((x["rank"], x["block"]) for x in slots.collect())
    parts = p.collect()
    assert all(x.times == times[x["rank"], x.block] for x in parts)
    again, places = Counter(), {}
    for i, rank, start, n in {(x.id, x["rank"], x.start, x["size"]) for x in parts}:
        again[i, n] += sum(times[rank, w // 16] for w in range(start, start + n))
        places.setdefault(rank, []).append((start, start + n))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    got = Counter()
    for i, n, _, _, t in a:
        got[i, n] += t
    assert +got == +again
    per_slot = slots.groupBy("shard", "slot").count()
    assert per_slot.where("count > 1").count() == 0
    assert slots.groupBy("rank", "block").count().agg(F.max("count")).first()[0] <= 2
    assert M.taken_words(*M.mix(docs.limit(0))[:2]).count() == 0


def test_mixed_documents_have_the_taken_words(spark):
    rows = [r for r in corpus(9) if r[0] not in (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _n int")
    r, p, _ = M.mix(docs)
    taken = {x.id: x.taken for x in M.taken_words(r, p).collect() if x.taken}
    got, texts = Counter(), {i: t for i, t, *_ in rows}
    for x in M.mixed_documents(docs).collect():
        ws = WORD.findall(x.text)
        got[x.doc_id] += len(ws)
        assert set(ws) <= set(WORD.findall(texts[x.doc_id])) and (x._n == 7 or x.doc_id < 10)
    assert got == taken


def test_mixed_documents_with_shared_ids(spark):
    text = lambda k, n: " ".join(f"t{k}x{j}" for j in range(n))
    rows = [(1, text(0, 64), "a"), (1, text(1, 64), "a"), (None, text(2, 64), "a"), (None, text(3, 64), None), (2, text(4, 64), "b"), (2, text(4, 64), "b"), (2, text(4, 64), "a"), (3, None, "b"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_key", F.lit(1)).withColumn("_TURN", F.lit(2))
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    got, held = Counter(), Counter()
    for r in out.collect():
        got[r.doc_id, r.source, r.text.split("x")[0]] += len(r.text.split())
    for i, t, s in rows:
        held[i, s, (t or "").split("x")[0]] += len((t or "").split())
    assert all(n <= 2 * held[k] for k, n in got.items()) and abs(sum(got.values()) - 1.5 * sum(held.values())) <= 3 * 64
    assert M.mixed_documents(docs.limit(0)).count() == 0


def test_many_sources_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 10)
    monkeypatch.setattr(M, "BUCKETS", 3)
    docs = spark.createDataFrame([(i, "w " * (130 if i % 50 == 0 else 70), f"s{i % 300}", 7) for i in range(900)], "doc_id long, text string, source string, block int")
    r, p, slots = M.mix(docs, block=8)
    total = sum(x.taken for x in M.taken_words(r, p).collect())
    assert abs(total - 1.5 * sum(x["size"] for x in r.collect())) < 8 * 300
    quotas = {x["rank"]: x.quota for x in M.source_plan(r.select("source", "size"), block=8).collect()}
    assert Counter(x["rank"] for x in slots.collect()) == quotas


def test_a_very_long_text_and_one_id_for_all(spark):
    docs = spark.createDataFrame([(None, "w " * 300_000, "a"), *((None, "v " * (k % 40), "b") for k in range(3000))], "doc_id long, text string, source string")
    out = M.taken_words(*M.mix(docs)[:2]).collect()
    assert len(out) == 3001 and all(0 <= x.taken <= 2 * x["size"] for x in out) and any(x["size"] == 300_000 and x.taken > 0 for x in out)


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(n)).alias("p"))
        got = [x.p for x in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def test_shard_counts_are_multinomial(spark):
    rows = [(i, "w " * 640, "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = M.source_plan(docs.select("source", F.lit(640).alias("size")), block=1)
    counts = M.draw_slots(plan, slots_per_shard=256).groupBy("shard", "rank").count().collect()
    p = {0: 1 / 2, 1: 1 / 6, 2: 1 / 3}
    for x in counts:
        if x.shard < 200:
            assert abs(x["count"] - 256 * p[x["rank"]]) < 6 * (256 * p[x["rank"]]) ** 0.5
