import re

import corpus_pipeline as P

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def own(i, n=60):
    return " ".join(f"v{i}x{j}" for j in range(n))


def test_stages(spark):
    rows = [(i, own(i), "en", f"s{i % 4}", 1) for i in range(40)]
    rows += [(100 + i, own(5), "en", "s1", 1) for i in range(5)] + [(200, "too short", "en", "s1", 1), (201, None, None, None, None), (202, "a b c d e f g h " * 9, "en", "s0", 1)]
    shared = "A line of more than forty characters that six documents hold."
    rows += [(300 + i, f"{own(300 + i)}\n{shared}", "de", f"s{i % 3}", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    seen = []
    for _, f in P.STAGES:
        out = f(spark, out, "")
        seen.append(out.collect())
        out = spark.createDataFrame(seen[-1], out.schema)
    assert all(list(r.asDict()) == COLUMNS for part in seen[:-1] for r in part)
    ids = [{r.doc_id for r in part} for part in seen]
    assert ids[0] == {*range(40), *range(100, 105), *range(300, 306)}
    assert ids[1] == ids[0] and [r.doc_id for r in seen[1] if shared in r.text] == [305]
    # copies of one line lose it in all but the last document; of the empty texts that leaves, one stays
    assert ids[2] == {*range(40), 104, *range(300, 306)} and len(seen[2]) == 47
    words = lambda part: sum(len(re.findall(r"\S+", r.text)) for r in part)
    assert abs(words(seen[3]) - 1.5 * words(seen[2])) <= 4 * 128
    assert len(seen[4]) == len(seen[3]) and all(r.n_tokens * 4 == len(r.ids) for r in seen[4])


def test_empty_corpus(spark):
    out = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in P.STAGES:
        out = f(spark, out, "")
        assert out.count() == 0


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 50
