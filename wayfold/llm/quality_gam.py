"""Quality classifier: an additive model with pairwise interactions, of per-feature lookup tables learnt by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table
from .simhash import _runs

FEATURES = (
    "log_words", "word_bytes", "symbols", "upper", "digits", "punctuation", "exclamations", "other_bytes", "symbol_words", "upper_words",
    "distinct_words", "top_word", "twice_running", "distinct_triples", "lines", "repeated_lines", "bars",
)
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)


def features(text: bytes | None) -> list[float]:
    """Numbers about a whole UTF-8 text, shares except for the first two; all 0 for a text without words. Words are counted in runs of bounded size; the distinct words and triples of one text are held, as numbers but for the words."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = bytes_ = twice = with_symbol = all_upper = triples = 0
    seen: Counter[bytes] = Counter()
    kinds: set[int] = set()
    for words in _runs(text, 2):
        fresh = words[2:] if n else words
        seen.update(fresh)
        n += len(fresh)
        bytes_ += sum(map(len, fresh))
        twice += sum(map(bytes.__eq__, words, words[1:]))
        got = [hash(t) for t in zip(words, words[1:], words[2:], strict=False)]
        triples += len(got)
        kinds.update(got)
    if not n:
        return [0.0] * len(FEATURES)
    for w, k in seen.items():
        if len(w.translate(None, _NOT_SYMBOL)):
            with_symbol += k
        if w.isupper():
            all_upper += k
    size = max(1, bytes_)
    letters = counts[65:91].sum() + counts[97:123].sum()
    punct = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log(n)), bytes_ / n, counts[list(_SYMBOLS)].sum() / size, counts[65:91].sum() / max(1, letters), counts[48:58].sum() / size, punct / size, counts[33] / size,
        counts[128:].sum() / size, with_symbol / n, all_upper / n, len(seen) / n, seen.most_common(1)[0][1] / n, twice / n, len(kinds) / max(1, triples),
        len(lines) / n, 1 - len(set(lines)) / len(lines), counts[124] / size,
    ]


@dataclass
class Model:
    """score = sigmoid(intercept + the sum of what each table has for the row's bins)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, f], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, most: int) -> np.ndarray:
    """Edges of at most `most` bins that hold about as many rows each."""
    return np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1], method="higher")) if len(column) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gain of each cut along the last axis, and the sums left of it."""
    lg, lh = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    tg, th = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)
    value = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
    return np.where((lh >= least) & (th - lh >= least), value, -np.inf), lg, lh


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """The values of a tree of a few leaves over bins of one feature: the best cut of any leaf, again and again."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            if b - a > 1:
                value = _gain(g[a:b], h[a:b], ridge, least)[0]
                k = int(np.argmax(value))
                if value[k] > best[0]:
                    best = (value[k], p, a + k + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float = 1.0, least: float = 2.0) -> tuple[np.ndarray, float]:
    """The values of a tree of depth two over the bins of two features, and its gain: one cut of the first, then one of the second in each part (or the other way round)."""
    best_gain, best = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        if gg.shape[0] < 2 or gg.shape[1] < 2:
            continue
        up_g, up_h = np.cumsum(gg, 0)[:-1], np.cumsum(hh, 0)[:-1]
        value = 0.0
        cuts = []
        for pg, ph in ((up_g, up_h), (gg.sum(0) - up_g, hh.sum(0) - up_h)):
            v = _gain(pg, ph, ridge, least)[0]
            k = np.argmax(v, -1)
            v = np.maximum(np.take_along_axis(v, k[:, None], -1)[:, 0], 0)
            cuts.append((k, v))
            value = value + v + pg.sum(-1) ** 2 / (ph.sum(-1) + ridge)
        value = value - gg.sum() ** 2 / (hh.sum() + ridge)
        r = int(np.argmax(value))
        if value[r] > best_gain:
            best_gain, out = float(value[r]), np.zeros_like(gg)
            for (k, v), part in zip(cuts, (slice(0, r + 1), slice(r + 1, None)), strict=True):
                for cols in [slice(0, k[r] + 1), slice(k[r] + 1, None)] if v[r] > 0 else [slice(None)]:
                    out[part, cols] = gg[part, cols].sum() / (hh[part, cols].sum() + ridge)
            best = out.T if flip else out
    return best, best_gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 64, leaves: int = 3, pair_bins: int = 16, pairs: int = 8, pair_rounds: int = 60) -> Model:
    """Cyclic gradient boosting: in each round each feature in turn gets a small tree over its bins, added to its table at a low rate; then the pairs that explain most of what is left get tables in the same way. Rows without a class, or of one class, give a constant."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m = Model(intercept=float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return m
    m.edges = [_cuts(c, bins) for c in x.T]
    m.pair_edges = [_cuts(c, pair_bins) for c in x.T]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, c, "right") for e, c in zip(m.edges, x.T, strict=True)]
    total = np.full(len(y), m.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for f, b in enumerate(at):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, len(m.tables[f])), np.bincount(b, h, len(m.tables[f])), leaves)
            m.tables[f] += step
            total += step[b]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(m.pair_edges, x.T, strict=True)]
    shape = [len(e) + 1 for e in m.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * shape[b] + coarse[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = slopes()
    gains = sorted(((_tree2(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)[:pairs]
    m.pairs = [(a, b) for v, a, b in gains if v > 0]
    m.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in m.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(m.pairs):
            g, h = slopes()
            step = rate * _tree2(grid(a, b, g), grid(a, b, h))[0]
            m.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return m


def _mapped(docs: DataFrame, columns: list[str], kind: str, name: str, make) -> DataFrame:
    """docs (…, text) with what make gives for a batch's texts instead of the text."""
    schema = docs.select(*columns, F.lit(None).cast(kind).alias(name)).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t.as_py()) for t in b.column(len(columns))])
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(make(x), arrow.field(len(columns)).type)], schema=arrow)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Model:
    """Fits on labelled rows of docs that are not held out: at most max_rows of the labels, those whose ids hash lowest, so which these are doesn't depend on order or partitions. That bounds what is broadcast, collected and fitted. Null labels and null ids are left out; of rows that share an id, the text with the lowest hash counts, once for each of the id's labels."""
    use = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("y")).where("l_id is not null and y is not null").where(~held_out(F.col("l_id"))).distinct()
    part = (1.1 * max_rows + 10 * max_rows**0.5 + 20) / max(use.count(), 1)
    if part < 1:  # the lowest hashes are below this, and few more
        use = use.where(F.xxhash64("l_id") < int(-(2**63) + part * 2**64))
    use = use.orderBy(F.xxhash64("l_id"), "l_id", "y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(use), F.col("id") == F.col("l_id"))  # max_rows at most
    measured = _mapped(rows, ["id", "y", "h"], "array<double>", "x", lambda x: list(x))
    got = sorted(measured.groupBy("id", "y").agg(F.min_by("x", "h").alias("x")).collect(), key=lambda r: (str(r.id), r.y))
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs; null and empty texts have a score, that of all features 0; repeated rows are scored each; other columns are not read."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return _mapped(rows, ["id"], "double", "score", lambda x: m.value.score(x))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_quality_gam": op10_quality_gam}
ORACLES: dict[str, str] = {}
