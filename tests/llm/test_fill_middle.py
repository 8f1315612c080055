import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm import fill_middle as M


def plainly(id_, text, seed=1, plain=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


ANY = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("<PSM>é日\U0001f600ab")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ANY, *[st.integers(0, 2**32 - 1)] * 4), min_size=1, max_size=8))
def test_cuts_and_round_trip(rows):
    texts = [r[0].encode() for r in rows]
    got = list(M.transformed(texts, [np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4)], 90, 20))
    for (text, h1, h2, h3, h4), (n, form, pre, mid, out) in zip(rows, got, strict=True):
        assert n == len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        marked = any(m in text for m in ("<P>", "<S>", "<M>"))
        assert form == ("plain" if not text or marked or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm")
        if form != "plain":
            assert (pre, mid) == (a, b - a)
            want = {"psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
            assert out.decode() == want
        assert M.restored(out, form).decode() == text


def test_marks_made_by_cuts():
    for text in ("<<P", "P>S>M>", "<S", ">", "<", "<P<S<M"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for h4 in (0, 99):
                    ((_, form, *_, out),) = M.transformed([text.encode()], [np.array([x]) for x in (a, b, 0, h4)], 90, 20)
                    assert form != "plain" and M.restored(out, form).decode() == text


def test_query(spark):
    texts = [None, "", "a", "né é 日本 \U0001f600\U0001f600 x", "has <P> in it", "x" * 3, "word " * 40, "ß" * 9, " \n\t", "é日" * 2_500_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (3, "other", "y"), (None, "no id", None)] + [(100 + i, "aé日\U0001f600"[i % 4] * i, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    made = M.rebuilt(M.fill_middle(docs)).collect()
    assert len(made) == len(rows)
    want = sorted(((i, *plainly(i, t), t or "") for i, t, _ in rows), key=repr)
    got = sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode(), r.restored.decode()) for r in made), key=repr)
    assert got == want
    forms = [r.form for r in made if r.n and r.id is not None and r.id >= 100]
    assert 0.85 < 1 - forms.count("plain") / len(forms) < 0.95 and 0.1 < forms.count("spm") / len(forms) < 0.3
    assert M.fill_middle(docs.limit(0)).count() == 0
    other = {r.id: r.prefix_chars for r in M.fill_middle(docs, seed=2).collect()}
    assert any(r.prefix_chars != other[r.id] for r in made)
    assert all(r.form == "plain" for r in M.fill_middle(docs.where("doc_id > 5"), plain_percent=0).collect())
