import itertools
import random
import re
import time
from html import unescape

import numpy as np
import pytest

from wayfold.llm import html_extract as X
from wayfold.llm.html_blocks import leaves
from wayfold.llm.html_pages import labelled_page

SF = "/root/testdata/sf0.01"


def texts(html):
    return [leaf.text for leaf in leaves(html)]


def test_blocks():
    assert texts("<p><b>Title &amp; x<br><p>two</p><div>a<p>b</p>c</div>") == ["Title & x", "two", "a", "b", "c"]
    assert texts("<ul><li>a<li>b <a href='x>y'>li\n nk</a></ul>t < 5 <!-- <p> --> u<script>var t='</p>'</script>v") == ["a", "b li nk", "t < 5 uv"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>&nbsp;&copyx &#169;&#x41;") == ["a", "b", "c", "©x ©A"]
    assert texts("<td>x</td><p title=it's>q</p></div>z<b") == ["x", "q", "z"]
    assert texts("<style>a<b</style><title>t</title><textarea><p>x</textarea><template><p>y</p></template>k<noscript>n</noscript>") == ["k"]
    assert texts("a<!-->b<!--->c<!-- --!>d<?x y>e</ f>g<![CDATA[h]]>i<!-- open") == ["abcdegi"]
    assert texts("") == texts("  \n ") == texts("<br></br><p></p>") == []
    assert texts("a<br>b<wbr>c<i>d</i>e") == ["a bcde"]
    assert [e.tag for e in leaves("<div><a>x<a>y</a></div>")[0].path] == ["div", "a"]
    assert leaves("<p>ab <a href=x>cd</a></p>")[0].linked == 2


def test_blocks_of_odd_and_long_pages():
    began = time.time()
    assert texts("<div>" * 200_000 + "x") == ["x"]
    assert texts("<p>" * 100_000 + "x") == ["x"]
    for t in ("<a b=" * 50_000, "<p x='" * 50_000, "<!--" * 50_000, "<script>" * 10_000, "&" * 100_000, "<" * 100_000):
        leaves(t)
    assert len(texts("<p>word word</p>" * 50_000)) == 50_000
    assert time.time() - began < 60


def _field(rng, names):
    m = X.Field({f: i for i, f in enumerate(names)})
    m.weights, m.pairs = rng.normal(size=len(names)), rng.normal(size=(X.EDGES, 2, 2))
    return m


def _total(m, found, labels):
    u, k = m.scores(found), X.steps(found)
    return sum(x for x, y in zip(u, labels, strict=True) if y) + sum(m.pairs[k[i], int(labels[i]), int(labels[i + 1])] for i in range(len(k)))


def test_viterbi_finds_the_best_of_all():
    rng, page = np.random.default_rng(3), random.Random(3)
    for _ in range(30):
        found = leaves(labelled_page(page, []))[:9]
        m = _field(rng, sorted({f for fs in X.features(found) for f in fs}))
        best = max(itertools.product((False, True), repeat=len(found)), key=lambda y: _total(m, found, y), default=())
        got = m.labels(found)
        assert len(got) == len(found) and abs(_total(m, found, got) - _total(m, found, best)) < 1e-9  # others may be as good


def test_training_is_the_likelihoods_maximum():
    """Weights moved any way from the fitted ones are less likely, all labellings counted one by one."""
    page = random.Random(5)
    pages = [(found, X.made_labels(found)) for found in (leaves(labelled_page(page, []))[:7] for _ in range(12))]
    ridge, m = 5.0, None
    m = X.fit(pages, rounds=1500, ridge=ridge, rate=0.05, least=1)
    blocks = sum(len(f) for f, _ in pages)

    def likelihood(w, p):
        t = X.Field(m.number, w, p)
        out = 0.0
        for found, y in pages:
            if found:
                out += _total(t, found, y) - np.logaddexp.reduce([_total(t, found, z) for z in itertools.product((0, 1), repeat=len(found))])
        return out / blocks - ridge / 200 * ((w**2).sum() + (p**2).sum())

    top, rng = likelihood(m.weights, m.pairs), np.random.default_rng(1)
    for _ in range(6):
        assert likelihood(m.weights + rng.normal(0, 0.05, m.weights.shape), m.pairs + rng.normal(0, 0.05, m.pairs.shape)) < top


@pytest.fixture(scope="module")
def model(spark):
    return X.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_held_out_made_pages(model):
    rng = random.Random(1234)
    right = n = 0
    for _ in range(300):
        found = leaves(labelled_page(rng, ["Some prose, as pages have it. " * 4, "It is another text that nobody wrote."]))
        got, want = model.labels(found), X.made_labels(found)
        right += sum(a == b for a, b in zip(got, want, strict=True))
        n += len(got)
    assert right / n > 0.97


def plainly(html):
    """What the article element of the table's simple pages has: found by patterns alone."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_query(spark, model):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in X.op12_html_extraction(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plainly(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


PROSE = "<p>The river rose in the night, and by the morning the lower meadows were under water, as they had been ten years before.</p>"


def test_other_sites(model):
    def main(html):
        found = leaves(html)
        return "\n".join(leaf.text for leaf, y in zip(found, model.labels(found), strict=True) if y)

    body = PROSE * 4
    page = f"""<body><div class="cookie-banner">We use cookies. <a href=/p>Privacy</a></div><header class="site-header"><div class="logo">Daily</div><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav></header>
    <main><article><h1>The flood</h1>{body}<div class="ad-slot">Buy a boat, now at half price.</div>{body}<section class="comments"><h3>Comments</h3><div class="comment"><p>I saw it too, the whole road was gone.</p></div></section></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/a>Old floods of the valley</a></ul></aside></main><form class="newsletter"><label>Your e-mail</label></form><footer>© 2024 Daily. All rights reserved.</footer>"""
    want = "\n".join(["The flood", *texts(body * 2)])
    assert main(page) == want
    soup = page.replace("article", "div class=entry-content", 1).replace("</article", "</div").replace("<main", "<div class=wrapper").replace("</main", "</div").replace("<aside", "<div").replace("</aside", "</div").replace("<footer", "<div class=footer").replace("</footer", "</div")
    assert main(soup) == want


def test_nulls_repeats_and_empty_tables(spark, model):
    rows = [(1, "u", None, "x"), (1, "u", "", "y"), (None, None, f"<article>{PROSE * 3}</article>", "z"), (1, "u", "<nav><a href=/>Home</a></nav>", None), (2, "v", "<p>w </p>" * 20_000, None), (1, "u", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = X.extract(df, model).collect()
    assert len(got) == 6 and [r.text for r in got if r.id == 1] == ["", "", "", ""]
    assert next(r.text for r in got if r.id is None).count("\n") == 2
    assert next(r for r in got if r.id == 2).n_blocks == 20_000
    assert X.extract(df.limit(0), model).count() == 0
    assert X.train(df.limit(0), made=20).number
    again = X.train(spark.read.parquet(f"{SF}/pages.parquet").repartition(7))
    assert np.allclose(again.weights, model.weights) and again.number == model.number
