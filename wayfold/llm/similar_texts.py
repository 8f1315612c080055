"""SimHash near-duplicates at a Jaccard similarity: longer fingerprints, more pigeonhole blocks, and the shingle sets of what is within the Hamming radius."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks as B
from .common import Remembered, cut, flushed, rekeyed, scratch
from .components import connected_components
from .simhash import _content, _runs, first_of_each

#: A bucket is crowded if it has more than so many near pairs for each of its rows: in the first round, and in later ones.
CROWDED = (8, 16)
#: Bits of the fingerprints that rows of crowded buckets are told apart by.
LONG_BITS = 1024
#: Rounds after which, or after one that finds no edge, a crowded bucket proposes all its near pairs that aren't in one component yet.
ROUNDS = 8
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _words() -> Remembered:
    return Remembered(lambda w: xxhash.xxh64_intdigest(w, 42), 100_000)


def shingle_set(text: bytes | None, shingle: int, known: Remembered) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text: A-Z lower-cased, words. No word: none; fewer words than a shingle has: one shingle of all of them."""
    parts, short = [], []
    for words in _runs((text or b"").lower(), shingle - 1):
        if len(words) < shingle:
            short = words
            continue
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - shingle + 1
        x = np.zeros(n, np.uint64)
        for i in range(shingle):
            x = _mixed(x * _MIX[2] + h[i : i + n] + np.uint64(1))
        parts.append(np.unique(x))
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b" ".join(short), 43)] if short else [], np.uint64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@dataclass(frozen=True)
class Blocks:
    """How fingerprints are made and split: bits in all, tables of width bits each, the Hamming radius, and that of fingerprints of LONG_BITS."""

    tables: int
    width: int
    bits: int
    radius: int
    long_radius: int


def plan_blocks(n: int, similarity: float, recall: float = 0.97, seed: int = 5) -> Blocks:
    """Sets at a Jaccard similarity s have sums of random signs with a correlation of 2 s / (1 + s) at least. Pairs of such sums are drawn, and the blocks are those that find them; where none compares fewer pairs than there are, 1 table of 4 bits with a radius that finds all (a table at width 1 searched at radius 1 has one bucket)."""
    rng = np.random.default_rng(seed)
    rho = 2 * similarity / (1 + similarity)
    held = [(np.zeros((4096, 0)), np.zeros((4096, 0)))]

    def more(bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        (a, b), have = held[0], held[0][0].shape[1]
        if have < bits:
            x, z = rng.normal(size=(2, 4096, -(-bits // 64) * 64 - have))
            held[0] = np.hstack([a, x]), np.hstack([b, rho * x + math.sqrt(1 - rho * rho) * z])
        return held

    found = B.plan(n, 1, more, recall) or (1, 1, 64, B.ANY)
    a, b = more(LONG_BITS)[0]
    far = np.quantile(((a[:, :LONG_BITS] > 0) != (b[:, :LONG_BITS] > 0)).sum(axis=1), 0.995)
    return Blocks(*found, math.ceil(float(far)))


def sums(shingles: np.ndarray, bits: int) -> np.ndarray:
    """For each bit of a set's fingerprint how many hashes have it, less those that don't. Hashes are as long as the fingerprint: each 64 bits are mixed anew from the shingle's."""
    counts = np.zeros((bits // 64, 64), np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        for k in range(bits // 64):
            h = _mixed(part + np.uint64(int(_MIX[2]) * (k + 1) % (1 << 64)))
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return (2 * counts - len(shingles)).reshape(-1)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, blocks: Blocks) -> DataFrame:
    """(id, content, key, n, code, buckets) for each row: key is a 128-bit hash of the text's set of shingles, n the size of the set, code its fingerprint. A text without a word has an empty key and no buckets."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("content", pa.string()), ("key", pa.binary()), ("n", pa.int64()), ("code", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def row(i, c, text, known) -> tuple:
        s = shingle_set(text, shingle, known)
        if not len(s):
            return i, c, b"", 0, b"", []
        x = sums(s, blocks.bits)[None]
        return i, c, xxhash.xxh3_128_digest(s.tobytes()), len(s), B.words(x).tobytes(), B.buckets(*B.keys(x, blocks.tables, blocks.width))[0].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words()
        rows = (row(i, c, t.as_py(), k) for b in batches for i, c, t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), repeat(known)))
        return flushed(rows, schema, lambda r: 120 + 8 * len(r[5]))

    return docs.select(F.col(id_col).alias("id"), _content(text_col).alias("content"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, content string, key binary, n long, code binary, buckets array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of (node, text)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words()
        rows = ((n, shingle_set(t.as_py(), shingle, known).view(np.int64)) for b in batches for n, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        return flushed(rows, schema, lambda r: 8 + 8 * len(r[1]))

    return texts.select("node", F.col("text").cast("binary")).mapInArrow(run, "node long, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least so much."""
    of = lambda end: sets.select(rekeyed(F.col("node")).alias(end), F.col("shingles").alias(f"{end}_set"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("a_set", "b_set")))
    return met.where(F.col("both") >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - F.col("both"))).select("a", "b")


def _long_codes(sets: DataFrame) -> DataFrame:
    """(node, code) of LONG_BITS for (node, shingles)."""
    schema = pa.schema([("node", pa.int64()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [B.words(sums(s.values.to_numpy().view(np.uint64), LONG_BITS)[None]).tobytes() for s in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], schema=schema)

    return sets.mapInArrow(run, "node long, code binary")


def _near_in(g: pa.Table, radius: int, similarity: float, round_: int, all_pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ends of the pairs that one bucket, or two blocks of one, propose; -1 for an end that is none. Of a crowded one, also the rows that these first ends are: those that any pair is left for.

    Near pairs are within the radius, of sizes that allow the similarity, and not both there by a flipped bit; those whose ends aren't in one component
    yet are proposed, in later rounds in the first bucket that has both. Of a crowded bucket none is in the first round, and in a later one each row's with the one of its near rows that has most near
    rows itself; with the next one of that order in each round.
    """
    node, comp, n, probe, left = (g.column(c).to_numpy() for c in ("node", "comp", "n", "probe", "is_left"))
    inside = g.column("a")[0] == g.column("b")[0]
    both = np.arange(len(node))
    rows, others = (both, both) if inside else (both[left], both[~left])
    none = node[:0], node[:0]
    if not len(others) or not len(rows):
        return *none, None
    codes = B.unpacked(g.column("code"), np.uint64)
    degree, found, total, crowded, open_ = np.zeros(len(node), np.int64), [], 0, False, np.zeros(len(node), bool)

    def strips(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(rows), B.STRIP):
            r = rows[k : k + B.STRIP]
            near = B.within(codes[r], codes[at], radius) & ~(probe[r][:, None] & probe[at][None])
            near &= np.minimum(n[r][:, None], n[at][None]) >= similarity * np.maximum(n[r][:, None], n[at][None])
            yield r, near

    if round_:
        bucket, all_ = g.column("bucket")[0].as_py(), g.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        (own, flip), t = np.split(all_, 2, axis=1), bucket >> 31 & 127

    def fresh(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        two = (own[i, t] == flip[j, t]) & (flip[i, t] == own[j, t])
        return ~B.retrieved(own[i, :t], flip[i, :t], own[j, :t], flip[j, :t]).any(axis=1) & (~two | (np.minimum(own[i, t], own[j, t]) == bucket))

    for r, near in strips(others):
        if round_:
            degree[r] += near.sum(axis=1)
            degree[others] += 0 if inside else near.sum(axis=0)
        near &= comp[r][:, None] != comp[others][None]
        if round_:
            i, j = np.nonzero(near)
            near[i, j] = fresh(r[i], others[j])
        open_[r] |= near.any(axis=1)
        open_[others] |= near.any(axis=0)
        total += int(near.sum()) // (1 + inside)
        if total > CROWDED[min(round_, 1)] * len(node) and not all_pairs:
            crowded = True
        if not crowded:
            i, j = np.nonzero(near)
            i, j = node[r[i]], node[others[j]]
            found.append((i[i < j], j[i < j]) if inside else (i, j))
    if crowded:
        partner = np.full(len(node), -1, np.int64)
        central = others[np.argsort(-degree[others], kind="stable")]
        for r, near in strips(central) if round_ else ():
            near &= comp[r][:, None] != comp[central][None]
            some = np.flatnonzero(near.any(axis=1))
            if len(some):
                upto = np.cumsum(near[some], axis=1, dtype=np.int32)
                pick = (upto > ((round_ - 1) % upto[:, -1])[:, None]).argmax(axis=1)
                partner[r[some]] = node[central[pick]]
        at = np.flatnonzero(open_)
        return node[at], partner[at], at
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none
    return a, b, None


def _proposed(entries: DataFrame, radius: int, similarity: float, round_: int, all_pairs: bool = False) -> DataFrame:
    """(a, b, bucket, probe): pairs that are proposed; of crowded buckets, a row for each of theirs that a pair is left for, with bucket and probe, and with b where it proposes one now."""
    group, schema = ["bucket", "a", "b"], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("probe", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in B.groups(batches, group):
            if g.num_rows > 1:
                a, b, at = _near_in(g, radius, similarity, round_, all_pairs)
                if len(a):
                    end = pa.array(b, mask=b < 0)
                    more = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.bool_())] if at is None else [pa.array(g.column(c).to_numpy()[at]) for c in ("bucket", "probe")]
                    yield pa.RecordBatch.from_arrays([pa.array(a), end, *more], schema=schema)

    rows = entries.select(*group, "is_left", "probe", "node", "comp", "n", "code", *(["buckets"] if round_ else []))
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long, bucket long, probe boolean")


def _joined(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known with comp, a node that this one is connected with, as the smallest of its own and its neighbours'. Two such steps bring a star together; what they don't bring together costs a proposal, not a link."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both.join(known.select(rekeyed(F.col("node")).alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("least"))
    return known.join(seen, F.col("node") == F.col("a"), "left").select("node", "code", "n", "buckets", F.coalesce(F.least("comp", "least"), F.col("comp")).alias("comp"))


def similar_edges(nodes: DataFrame, sets_of, blocks: Blocks, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes (node, n, code, buckets) whose components are those of all pairs that meet in a block within the Hamming radius and have the similarity.

    Pairs are sought inside the tasks, in codes. Rows of crowded buckets, as large groups of near copies make them, get longer fingerprints, and propose a pair
    each in every round, until their buckets have few near pairs whose ends aren't in one component; then these are proposed. Each proposed pair is decided
    by its sets; texts come for those only.
    """
    spark = nodes.sparkSession
    at = scratch(spark, "edges")
    edges: list[DataFrame] = []

    def decided(pairs: DataFrame, sets: DataFrame) -> int:
        # written and read, not checkpointed: a checkpoint keeps the constraints of its plan, and they multiply with each round
        _similar(pairs, sets, similarity).write.parquet(f"{at}/{len(edges)}")
        edges.append(spark.read.schema("a long, b long").parquet(f"{at}/{len(edges)}"))
        return edges[-1].count()

    entries = nodes.select("node", "n", "code", F.size("buckets").alias("all"), F.posexplode("buckets").alias("pos", "bucket")).select("node", "n", "code", "bucket", (2 * F.col("pos") >= F.col("all")).alias("probe"))
    proposed = cut(_proposed(B.dealt(B.marked(entries)).withColumn("comp", F.col("node")), blocks.radius, similarity, 0))
    pairs_of = lambda p: cut(p.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    crowd_of = lambda p: cut(p.where("bucket is not null").select(F.col("a").alias("node"), "bucket", "probe").distinct())
    pairs, crowd = pairs_of(proposed), crowd_of(proposed)
    decided(pairs, cut(sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())))
    if not crowd.isEmpty():
        sets = cut(sets_of(crowd.select("node").distinct()))
        known = _long_codes(sets).join(nodes.select(rekeyed(F.col("node")).alias("node"), "n", "buckets"), "node").withColumn("comp", F.col("node"))
        for k in range(1, ROUNDS + 2):
            known = cut(_joined(_joined(known, edges[-1]), edges[-1]))
            last = k > ROUNDS or k > 1 and not new
            named = known.select(rekeyed(F.col("node")).alias("node"), "n", "code", "comp", "buckets")
            proposed = cut(_proposed(B.dealt(B.marked(crowd.join(named, "node"))), blocks.long_radius, similarity, k, last))
            new, crowd = decided(pairs_of(proposed), sets), crowd_of(proposed)
            if crowd.isEmpty():
                break
    return functools.reduce(DataFrame.unionByName, edges)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, content, component_id, root) for each row of docs; root names the row's group, component_id is the smallest id in it.

    Groups are the components over pairs of texts whose sets of shingles have the Jaccard similarity, of which those at just the similarity are found with a
    probability of 0.97 and closer ones more surely. Equal sets are one node, however many documents have them; texts without a word (null, empty, white
    space) are one group. Null ids are ignored in the minimum (all null: null); repeated rows are kept; an empty table gives no rows; other columns are not
    read. Whole texts are hashed, in runs of bounded size; texts of documents that are compared come once more, one of each node.
    """
    blocks = plan_blocks(docs.count(), similarity)
    rows = cut(signatures(docs, id_col, text_col, shingle, blocks))
    nodes = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.min("content").alias("content"), F.first("n").alias("n"), F.first("code").alias("code"), F.first("buckets").alias("buckets"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    def sets_of(wanted: DataFrame) -> DataFrame:
        of = nodes.select(rekeyed(F.col("node")).alias("node"), F.col("content").alias("c")).join(wanted, "node")
        texts = docs.select(F.col(text_col).alias("text"), _content(text_col).alias("content"))
        return shingle_sets(texts.join(of, F.col("content") == F.col("c")).dropDuplicates(["node"]).select("node", "text"), shingle)

    edges = similar_edges(nodes.select("node", "n", "code", "buckets"), sets_of, blocks, similarity)
    labels = connected_components(edges, "a", "b").select(rekeyed(F.col("node")).alias("node"), "component")
    nodes = nodes.select("key", "node", "first_id").join(labels, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = nodes.select("key", "root").join(least.select(rekeyed(F.col("root")).alias("root"), "component_id"), "root").select(F.concat("key", F.lit(b"")).alias("key"), "component_id", "root")
    return rows.select("id", "content", "key").join(groups, "key").select("id", "content", "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group, with all columns; which one is as in simhash.one_of_each."""
    return first_of_each(docs, similar_groups(docs, id_col, text_col, shingle, similarity), id_col, text_col)
