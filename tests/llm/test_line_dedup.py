import hashlib
import random

import numpy as np

from wayfold.llm import line_dedup as L


def plain(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    rank = lambda i: (i is not None, i or 0)
    last = {k: max(v, key=rank) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    common = [f"{w} " + "é" * 20 + " Common line that many documents hold" for w in ("First", "SECOND", "third", "x" * 30)] + ["é" * 39, "é" * 40, "\t\x0b" + "Q" * 40 + " ", "short"]
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, common[0]), (3, common[0] + "\nmore"), (None, common[5])]
    for i in range(60):
        lines = [f"own line {i} {j} of this document, which no other one has in it" for j in range(rng.randrange(4))] + [x.swapcase() if x.isascii() and rng.random() < 0.5 else x for x in rng.choices(common, k=rng.randrange(5))]
        rng.shuffle(lines)
        rows.append((i * 7 - 50, "\n".join(lines)))
    return rows + rows[-1:]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", 3) for i, t in rows], "doc_id long, text string, n_lines string, drop int").repartition(5)
    assert sorted(((r.id, r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(docs).collect()), key=str) == plain(rows)
    carried = L.dedup_lines(docs, carry=("n_lines", "drop")).select("id", "text", "carried.*")
    assert {(r.n_lines, r.drop) for r in carried.collect()} == {("s", 3)}
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_filled_up_filters_stay_exact(spark):
    rows = corpus() + [(1000 + i, "\n".join(f"line {i * 400 + j} that only one document of all of these holds" for j in range(400))) for i in range(150)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(7)
    drops = {r.id: {bytes(k) for k in r.drop} for r in L.repeated_lines(docs, max_filter_bytes=8192).collect()}
    assert set(drops) == {i for i, _, n, _ in plain(rows) if n}


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (5000, 2), dtype=np.int64).view(np.uint64)
    f = L.Filters(1)
    f.add(keys)
    f.add(keys[:500])
    places = L._places(keys, 1)
    assert f.has(f.once, places).all() and f.has(f.twice, places[:500]).all()
    assert f.has(f.twice, places[500:]).mean() < 0.2
    for bits in (f.once, f.twice, np.zeros_like(f.once)):
        assert (L._unpacked(L._packed(bits)) == bits).all()


def test_line_key():
    assert L.line_key(b" " + b"A" * 40 + b"\x0c", 40) == L.line_key(b"a" * 40, 40)
    assert L.line_key("é".encode() * 39, 40) is None and L.line_key("é".encode() * 40, 40)
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
