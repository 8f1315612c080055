from urllib.parse import quote

from wayfold.llm import perspectives as P

SCHEMA = "conv_id long, turn long, role string, text string, body string, part int"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        for me in {r[2] for r in mine} - {None, "system"}:
            parts = {}
            for r in mine:
                parts.setdefault(None if r[1] is None else r[1] // 64, []).append(r)
            for part, turns in parts.items():
                turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", (r[3] or "").replace("<|", "< |") + "<|end|>\n"))
                for k in range(0, len(turns), 64):
                    text, spans = "", []
                    for _, _, role, said, *_ in turns[k : k + 64]:
                        label = "assistant" if role == me else "system" if role == "system" else "user" if role is None else "user name=" + quote(role, safe="")
                        text += f"<|start|>{label}\n"
                        begin = len(text)
                        text += (said or "").replace("<|", "< |") + "<|end|>\n"
                        if role == me:
                            spans.append((begin, len(text)))
                    out[conv, me, part, k // 64] = (len(turns[k : k + 64]), text, spans)
    return out


def test_against_brute_force(spark):
    rows = [(1, i, who, t) for i, (who, t) in enumerate([("system", "rules"), ("ann b", "hi"), ("bob", "<|end|> ü\U0001f600"), ("ann b", None), (None, "who?"), ("system", "x"), ("", "nobody")])]
    rows += [(2, i, f"s{i % 3}", f"text {i}") for i in range(150)] + [(3, 5, "a", f"{i}") for i in range(100)]
    rows += [(4, 0, "system", "alone"), (5, None, "a", "n"), (5, 0, "a", "z"), (None, 1, "a", "x"), (None, 1, "b", "y"), (6, 1, "a", "same"), (6, 1, "a", "same"), (8, 0, "a b", "x"), (8, 1, "a_b", "y"), (8, 2, "a+b*~é%<|>", "z"), (7, 0, "a", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = {(r.conv_id, r.speaker, r.part, r.piece): (r.n_turns, r.text, [tuple(s) for s in r.spans]) for r in P.perspectives(df).collect()}
    assert got == brute(rows)
    assert P.perspectives(df.limit(0)).count() == 0


def test_each_text_is_learnt_once_in_all(spark):
    src = "/root/testdata/sf0.01/conversations.parquet"
    got = P.perspectives(spark.read.parquet(src)).collect()
    learnt = sum(s.end - s.begin for r in got for s in r.spans)
    rows = [r for r in spark.read.parquet(src).collect() if r.role not in (None, "system")]
    assert learnt == sum(len((r.text or "").replace("<|", "< |")) + 8 for r in rows)
