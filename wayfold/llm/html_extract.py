"""Main text of web pages: a linear-chain conditional random field over leaf blocks, learnt from labelled pages and decoded by Viterbi."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import flushed, table
from .html_blocks import Leaf, leaves
from .html_pages import CONTENT, LABEL, labelled_page

#: How far apart two blocks that follow each other are in the tree: steps up or down to where their elements part, up to one less.
EDGES = 5
_NAMES = re.compile(r"""(?:^|[\s/"'])(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_UNSEEN = re.compile(r"""(?:^|[\s"'])hidden(?:[\s=]|$)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words that a block may have; each kind is a feature of its own.
_CUES = {
    "rights": "© copyright reserved legal imprint impressum", "consent": "cookie cookies privacy consent accept gdpr", "join": "subscribe subscribers newsletter register login password email e-mail",
    "promo": "advertisement advert sponsored sponsor promoted buy offer discount", "share": "share tweet follow facebook twitter", "more": "related read recommended trending popular", "reply": "comment comments reply replies posted says ago",
    "byline": "by min updated published",
}
_CUE = {w: k for k, words in _CUES.items() for w in words.split()}
_BARE = str.maketrans(dict.fromkeys(".,;:!?()[]\"'|»›·•", " "))


@lru_cache(maxsize=20_000)
def _names(tag: str, attributes: str) -> frozenset[str]:
    """What an element says of what stands in it: its tag, and the words of its class, id, role and the like. Those of the whole page say nothing."""
    if tag in ("html", "body"):
        return frozenset()
    found = {f"in {tag}"}
    for m in _NAMES.finditer(attributes[:1000]):
        found.update("named " + p.lower()[:20] for p in _PART.findall(m[1]) if len(p) > 1)
    if _UNSEEN.search(attributes):
        found.add("unseen")
    return frozenset(found)


def _step(value: float, edges: tuple[float, ...]) -> int:
    return sum(value > e for e in edges)


def features(found: list[Leaf]) -> Iterator[set[str]]:
    """The features of each block: of the elements that it stands in, of its own element, of its text and its place."""
    n = len(found)
    for k, leaf in enumerate(found):
        text = leaf.text
        words = text.count(" ") + 1
        out = {"any"}
        for e in leaf.path:
            out |= _names(e.tag, e.attributes)
        if leaf.path:
            out.add(f"of {leaf.path[-1].tag}")
        share = leaf.linked / len(text)
        size = _step(words, (2, 5, 10, 20, 50))
        out.update((f"size {size}", f"linked {_step(share, (0, 0.3, 0.8))}", f"place {k * 5 // n}", f"ends {text[-1] in '.!?…:;。'}", f"digits {_step(sum(map(text.count, '0123456789')) / len(text), (0, 0.1, 0.4))}"))
        told = _CUE.keys() & set(text.lower().translate(_BARE).split())
        out.update(f"cue {_CUE[w]} {min(size, 3)}" for w in told)
        if any(x in text for x in "|»›·•"):
            out.add(f"bars {min(size, 3)}")
        yield out


def steps(found: list[Leaf]) -> np.ndarray:
    """The kind of each edge from a block to the next, below EDGES."""
    out = np.zeros(max(len(found) - 1, 0), np.int64)
    for k, (a, b) in enumerate(zip(found, found[1:], strict=False)):
        same = 0
        for x, y in zip(a.path, b.path, strict=False):
            if x is not y:
                break
            same += 1
        out[k] = min(max(len(a.path), len(b.path)) - same, EDGES - 1)
    return out


@dataclass
class Field:
    """Weights of the features for the label "content", and of the four pairs of labels for each kind of edge."""

    number: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((EDGES, 2, 2)))

    def scores(self, found: list[Leaf]) -> np.ndarray:
        number, w = self.number, self.weights
        return np.array([sum(w[number[f]] for f in fs if f in number) for fs in features(found)])

    def labels(self, found: list[Leaf]) -> list[bool]:
        """The likeliest labels of all blocks of a page together, by Viterbi; of equally likely ones, content last."""
        if not found:
            return []
        unary, kinds = self.scores(found).tolist(), steps(found).tolist()
        pairs = self.pairs.tolist()
        best, back = (0.0, unary[0]), []
        for u, k in zip(unary[1:], kinds, strict=True):
            (aa, ab), (ba, bb) = pairs[k]
            no, yes = (best[0] + aa, best[1] + ba), (best[0] + ab, best[1] + bb)
            back.append((no[1] > no[0], yes[1] > yes[0]))
            best = (max(no), max(yes) + u)
        label = best[1] > best[0]
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[Leaf], list[bool]]], rounds: int = 200, ridge: float = 0.002, rate: float = 0.2, least: int = 3) -> Field:
    """Maximises the likelihood of the pages' labels, less ridge times the squared weights, by gradients from forward and backward sums over all pages at once (Adam). Features of fewer than `least` blocks are left out."""
    pages = [(found, y) for found, y in pages if found]
    count: Counter[str] = Counter()
    all_features = [list(features(found)) for found, _ in pages]
    for fs in all_features:
        for f in fs:
            count.update(f)
    m = Field({f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= least))})
    m.weights = np.zeros(len(m.number))
    if not pages:
        return m
    n, longest = len(pages), max(len(found) for found, _ in pages)
    entry, block = [], []
    y, real, kind = np.zeros((longest, n), bool), np.zeros((longest, n), bool), np.zeros((longest, n), np.int64)
    for p, ((found, labels), fs) in enumerate(zip(pages, all_features, strict=True)):
        y[: len(found), p], real[: len(found), p] = labels, True
        kind[1 : len(found), p] = steps(found)
        for k, f in enumerate(fs):
            own = sorted(m.number[x] for x in f if x in m.number)  # in one order, so that reruns sum alike
            entry += own
            block += [k * n + p] * len(own)
    entry, block = np.array(entry), np.array(block)
    size = longest * n
    both = real[1:]
    truth = np.zeros((EDGES, 2, 2))
    np.add.at(truth, (kind[1:][both], y[:-1][both].astype(int), y[1:][both].astype(int)), 1)
    mean, square = [np.zeros_like(m.weights), np.zeros_like(m.pairs)], [np.zeros_like(m.weights), np.zeros_like(m.pairs)]
    blocks = real.sum()
    for t in range(1, rounds + 1):
        u = np.bincount(block, m.weights[entry], size).reshape(longest, n)
        unary = np.stack([np.zeros_like(u), u], -1)
        edge = m.pairs[kind]  # (longest, n, 2, 2); what a page doesn't have passes its sums on
        edge[~real] = np.where(np.eye(2, dtype=bool), 0.0, -1e9)
        unary[~real] = 0
        ahead = [unary[0]]
        for k in range(1, longest):
            ahead.append(np.logaddexp.reduce(ahead[-1][:, :, None] + edge[k], 1) + unary[k])
        behind = [np.zeros((n, 2))]
        for k in range(longest - 1, 0, -1):
            behind.append(np.logaddexp.reduce(edge[k] + (unary[k] + behind[-1])[:, None, :], 2))
        fore, back = np.stack(ahead), np.stack(behind[::-1])
        total = np.logaddexp.reduce(fore[0] + back[0], -1)
        share = np.exp(fore[:, :, 1] + back[:, :, 1] - total)
        joint = np.exp(fore[:-1, :, :, None] + edge[1:] + (unary[1:] + back[1:])[:, :, None, :] - total[None, :, None, None])
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, kind[1:][both], joint[both])
        off = ((y - share) * real).reshape(-1)
        slopes = (np.bincount(entry, off[block], len(m.weights)) / blocks - ridge / 100 * m.weights, (truth - expected) / blocks - ridge / 100 * m.pairs)
        for i, (w, g) in enumerate(zip((m.weights, m.pairs), slopes, strict=True)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            w += rate * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-8)
    return m


def own_labels(found: list[Leaf]) -> list[bool] | None:
    """Labels by what a page's elements mean: what is in its article or main element, but not in a menu, header, footer, sidebar or form within it. None without such an element."""
    out, marked = [], False
    for leaf in found:
        label = False
        for e in leaf.path:
            if e.tag in ("article", "main"):
                label = marked = True
            elif label and e.tag in ("nav", "aside", "footer", "form", "dialog") or e.tag == "header" and label and not leaf.path[-1].tag.startswith("h"):
                label = False
                break
        out.append(label)
    return out if marked else None


def made_labels(found: list[Leaf]) -> list[bool]:
    """Labels of a made page: each block's innermost element with a label tells."""
    return [next((CONTENT in e.attributes for e in reversed(leaf.path) if LABEL in e.attributes), False) for leaf in found]


def train(pages: DataFrame, html_col: str = "html", sample: int = 300, longest: int = 50_000, made: int = 1000, seed: int = 7) -> Field:
    """Fits a field on labelled pages: up to `sample` of the table's own, each of at most `longest` characters, and `made` ones.

    The table's own are those whose html hashes lowest, found by a threshold on the hash, so they depend on neither order nor partitions; they are labelled by their article or main
    elements, and those without are left out. The made pages are of the same texts, and of made-up words where there are none, in many forms of markup (html_pages). These bounds are all that is collected.
    """
    rows = pages.select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html")).where(F.col("html").isNotNull() & (F.length("html") <= longest))
    n = rows.count()
    part = min(1.0, 3 * sample / max(n, 1))
    kept = rows.where(F.col("h") <= int(-(2**63) + part * (2**64 - 1))).distinct() if part < 1 else rows.distinct()
    own = []
    for r in kept.orderBy("h", "html").limit(sample).collect():
        found = leaves(r.html)
        labels = own_labels(found)
        if labels is not None:
            own.append((found, labels))
    yes = [f.text for found, ls in own for f, y in zip(found, ls, strict=True) if y and len(f.text) < 3000]
    rng = random.Random(seed)
    forged = [leaves(labelled_page(rng, yes)) for _ in range(made)]
    return fit(own + [(found, made_labels(found)) for found in forged])


def extract(pages: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_blocks, n_kept) for each row of pages: the blocks of the whole html that the model takes for the article's, in page order, joined by line ends.

    Null and empty html, and pages of which no block is kept, have an empty text; repeated rows are read each; an empty table gives no rows; other columns are not read. A task holds one page's blocks; nothing is
    shuffled.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    long = F.lit(0).cast("long")
    schema = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.lit("").alias("text"), long.alias("n_blocks"), long.alias("n_kept")).schema
    arrow = to_arrow_schema(schema)

    def one(html: str | None) -> tuple[str, int, int]:
        found = leaves(html or "")
        kept = [leaf.text for leaf, y in zip(found, shared.value.labels(found), strict=True) if y]
        return "\n".join(kept), len(found), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), u.as_py(), *one(h.as_py())) for b in batches for i, u, h in zip(*(b.column(c) for c in range(3)), strict=True))
        yield from flushed(rows, arrow, lambda r: len(r[2]))

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, schema)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = extract(pages, train(pages))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


QUERIES = {"op12_html_extraction": op12_html_extraction}
ORACLES: dict[str, str] = {}
