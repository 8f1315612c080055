import random
import re
from collections import Counter

from wayfold.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, window=8):
    text = text or ""
    ws = WORD.findall(text)
    seen = Counter(tuple(ws[i : i + window]) for i in range(len(ws) - window + 1))
    hit = {j for i in range(len(ws) - window + 1) if seen[tuple(ws[i : i + window])] > 1 for j in range(i, i + window)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \x0b\n", "a", "a b c d e f g h", "a b c d e f g h i", "x " * 9, "ab\xa0c\x85d #*$ <é>\n#\n#\n \n \nab", "w\n" * 30]
    for _ in range(60):
        ws = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 120))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in ws * rng.choice([1, 1, 2])))
    rows = [(i, t, "s", "c", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, content string, n_words int")
    got = {r.id: r for r in Q.quality_rules(docs, min_docs=1000).collect()}  # no line is frequent
    for i, t, *_ in rows:
        r, e = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, (t, e)
        assert r.base_failed == (e[0] < 20 or 100 * e[4] > 30 * e[0])
        assert r.kept == (not r.base_failed) and r.removed_words == 0
    assert Q.quality_rules(docs.limit(0)).count() == 0


def own(i, n=30):
    return " ".join(f"v{i}x{j}" for j in range(n))


def test_line_frequency(spark):
    rows = [(i, f"{own(i)}\n  Shared LINE of the\thost ", "h") for i in range(12)]
    rows += [(100 + i, f"{own(100 + i, 10)}\nshared line of the host\n{own(0, 0)}", "h") for i in range(3)]  # too few words
    rows += [(200 + i, own(999) + "\n" + own(998), "h") for i in range(12)]  # copies
    rows += [(300 + i, f"{own(300 + i)}\nshared line of the host", "rare") for i in range(4)]
    rows += [(400 + i, "\n".join([own(400 + i, 12), "shared line of the host " * 1, own(77, 20)]), "h") for i in range(9)]  # lose over half
    rows += [(500, f"{own(500)}\nshared line of the host", None), (None, own(501), None), (None, own(501), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict = Q.quality_rules(docs, min_docs=9, max_share=0.1, copies=False)
    kept = {r.id for r in verdict.where("kept").collect()}
    assert kept == {*range(12), *range(200, 212), *range(300, 304), 500, None}
    out = Q.apply_quality_rules(docs, verdict).collect()
    assert len(out) == 12 + 12 + 4 + 1 + 2
    texts = {r.doc_id: r.text for r in out}
    assert texts[3] == own(3) and texts[300].endswith("host") and texts[500].endswith("host") and texts[203] == own(999) + "\n" + own(998)
    counted = {r.id: r for r in Q.quality_rules(docs, min_docs=9, max_share=0.1).collect()}
    assert all(counted[200 + i].removed_words == 60 and not counted[200 + i].kept for i in range(12)), "copies are documents"
    assert {i for i, r in counted.items() if r.kept} == kept - {*range(200, 212)}


def test_the_table_has_frequent_lines_and_depleted_documents(spark):
    got = Q.op1_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.removed_words > 0 for r in got) > 50
    assert sum(not r.base_failed and not r.kept for r in got) > 3


def test_very_long_text(spark):
    text = "\n".join(own(k, 200) for k in range(2000))
    docs = spark.createDataFrame([(1, text, "h"), (2, text + "\n" + own(5, 200), "h")], "doc_id long, text string, source string")
    got = {r.id: r for r in Q.quality_rules(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (400_000, 0, True)
    assert (got[2].n_words, got[2].n_dup_lines, got[2].n_repeat_words) == (400_200, 1, 400)


def test_repeated_rows_lose_a_frequent_line_once(spark):
    line = "shared line of the host with ten words in it"
    rows = [(i, f"{own(i, 21)}\n{line}", "h") for i in range(12)] + [(5, f"{own(5, 21)}\n{line}", "h")] * 3 + [(None, f"{own(6, 21)}\n{line}", "h")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict = Q.quality_rules(docs, min_docs=9, max_share=0.1)
    got = [(r.removed_words, r.kept) for r in verdict.collect()]
    assert got == [(10, True)] * 17
    assert sorted(r.text for r in Q.apply_quality_rules(docs, verdict).collect()) == sorted([own(i, 21) for i in range(12)] + [own(5, 21)] * 3 + [own(6, 21)] * 2)


def test_lines_of_small_and_of_very_large_hosts(spark):
    rows = [(i, f"{own(i)}\nline of a small host", "small") for i in range(12)] + [(100 + i, f"{own(100 + i)}\nrare line", "rare") for i in range(10)]
    rows += [(1000 + i, own(1000 + i) + ("\nline of the large host" if i < 31 else "\nseldom line" if i < 60 else ""), "large") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lost = lambda **limits: {r.id for r in Q.quality_rules(docs, **limits).where("removed_words > 0").collect()}
    assert lost(min_docs=13) == set()
    assert lost(min_docs=11, always_docs=30) == {*range(12), *range(1000, 1031)}
