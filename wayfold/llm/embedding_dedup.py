"""Embedding near-dedup: iterative quantisation to binary codes, multi-index Hamming tables, reranking with the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut, rekeyed, table
from .components import connected_components

@dataclass
class Index:
    """Codes of a vector: the signs of its centred direction in learnt directions. Table t is keyed by the t-th `width` bits of the code and searched at radius 1, in the direction of the substring's least certain bit. width 0: one bucket for all."""

    mean: np.ndarray
    directions: np.ndarray  # (dim, bits), bits a multiple of 64
    tables: int
    width: int
    radius: int

    def coded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes as (n, bits / 64) words, keys (n, tables) and the keys with the least certain bit flipped, of unit vectors."""
        x = (unit - self.mean) @ self.directions
        return B.words(x), *B.keys(x, self.tables, self.width)


@dataclass
class Quantiser:
    """Iterative quantisation of a sample. Its principal axes are rotated so that the signs of its coordinates lose least: rounding to the nearest corner and the rotation that fits the corners best take turns. Each rotation gives as many bits as there are axes; others, from different starts, are learnt when more bits are asked for."""

    unit: np.ndarray
    rounds: int = 30
    rng: np.random.Generator = field(default_factory=lambda: np.random.default_rng(7))
    found: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.mean = self.unit.mean(axis=0)
        x = self.unit - self.mean
        variance, axes = np.linalg.eigh(x.T @ x / len(x))
        self.axes = axes[:, variance > 1e-12][:, ::-1]
        self.v = x @ self.axes

    def directions(self, bits: int) -> np.ndarray:
        k = self.axes.shape[1]
        while k and sum(f.shape[1] for f in self.found) < bits:
            r = np.linalg.qr(self.rng.normal(size=(k, k)))[0]
            for _ in range(self.rounds):
                a, _, b = np.linalg.svd(np.sign(self.v @ r).T @ self.v)
                r = (a @ b).T
            self.found.append(self.axes @ r[:, self.rng.permutation(k)])
        return np.hstack(self.found)[:, :bits] if k else np.zeros((len(self.mean), bits))


def sample_pairs(unit: np.ndarray, threshold: float, most: int = 4096, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors on which recall is measured, of three kinds: those that the sample itself has at the threshold or above (if 20 or more), a vector turned, about the sample's mean, towards another one to just the threshold, and a vector with noise that is equal in all directions, at the threshold too."""
    rng = np.random.default_rng(seed)
    u = unit[rng.permutation(len(unit))[:most]]
    mean, z = unit.mean(axis=0), unit[rng.integers(0, len(unit), len(u))]
    low, high = np.zeros(len(u)), np.full(len(u), math.pi / 2)
    for _ in range(40):
        at = (low + high) / 2
        y = mean + np.cos(at)[:, None] * (u - mean) + np.sin(at)[:, None] * (z - mean)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        far = (u * y).sum(axis=1) < threshold
        low, high = np.where(far, low, at), np.where(far, at, high)
    noise = rng.normal(size=u.shape)
    noise -= (noise * u).sum(axis=1, keepdims=True) * u
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    pairs = [(u, y), (u, threshold * u + math.sqrt(max(0.0, 1 - threshold**2)) * noise)]
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    if len(i) >= 20:
        some = rng.permutation(len(i))[:most]
        pairs.append((u[i[some]], u[j[some]]))
    return pairs


def fit(unit: np.ndarray, n: int, threshold: float, recall: float, tables: int = 64) -> Index:
    """The index for n vectors of which unit is a sample: what costs least of what finds sampled pairs at the threshold with probability `recall`. Where no index of `tables` tables would compare fewer pairs than there are, all share one bucket."""
    dim, q = unit.shape[1], Quantiser(unit)
    whole = Index(q.mean, np.zeros((dim, 64)), 1, 0, B.ANY)
    if not q.axes.shape[1]:
        return whole
    pairs = sample_pairs(unit, threshold)
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((len(a), 0)), np.zeros((len(b), 0))) for a, b in pairs]

    def more(bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        have = held[0][0].shape[1]
        if have < bits:
            d = q.directions(-(-bits // 64) * 64)[:, have:]
            held[:] = [(np.hstack([ha, (a - q.mean) @ d]), np.hstack([hb, (b - q.mean) @ d])) for (ha, hb), (a, b) in zip(held, pairs, strict=True)]
        return held

    found = B.plan(n, len(pairs), more, recall, tables)
    if found is None:
        return whole
    t, width, bits, radius = found
    return Index(q.mean, q.directions(bits), t, width, radius)


@dataclass
class Indexes:
    """An index for each length of vectors that the sample has. Vectors of other lengths, which are few, share one bucket for each length."""

    of: dict[int, tuple[int, Index]]

    def slot(self, dim: int) -> int:
        return self.of[dim][0] if dim in self.of else 1 << 24 | dim

    def radius(self, bucket: int) -> int:
        return next((i.radius for s, i in self.of.values() if s == bucket >> 38), B.ANY)


def fit_all(sample: list[np.ndarray], n: int, threshold: float, recall: float) -> Indexes:
    """sample: unit vectors of all lengths, of n in all."""
    by: dict[int, list[np.ndarray]] = {}
    for u in sample:
        by.setdefault(len(u), []).append(u)
    return Indexes({dim: (k, fit(np.stack(us), max(len(us), n * len(us) // len(sample)), threshold, recall)) for k, (dim, us) in enumerate(sorted(by.items()))})


def _rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat doubles of a list column without nulls, and where each row ends."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(col.value_lengths().to_numpy())


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, scaled by the largest component first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coded(vectors: DataFrame, indexes: Indexes) -> DataFrame:
    """vectors (node, w, v) with code, keys (those of all tables, then those with a bit flipped, as 4 bytes each) and buckets. A bucket's number has the length's slot, the table and the key."""
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)
    schema = vectors.select("node", F.lit(b"").alias("code"), F.lit(b"").alias("keys"), F.array(F.lit(0).cast("long")).alias("buckets")).schema
    arrow = pa.schema([("node", pa.int64()), ("code", pa.binary()), ("keys", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = _rows(b.column(1))
            sizes = np.diff(ends, prepend=0)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                slot, index = shared.value.slot(int(dim)), shared.value.of.get(int(dim), (0, None))[1]
                if index is None or not index.width:
                    code, keys, buckets = [b""] * len(at), [b""] * len(at), np.full((len(at), 1), slot << 38, np.int64)
                else:
                    words, own, flipped = index.coded(_unit(flat[(ends[at] - dim)[:, None] + np.arange(dim)]))
                    code, keys = [x.tobytes() for x in words], [x.tobytes() for x in np.hstack([own, flipped])]
                    buckets = B.buckets(own, flipped, slot)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, buckets.shape[1]), pa.int32()), pa.array(buckets.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(code, pa.binary()), pa.array(keys, pa.binary()), lists], schema=arrow)

    return vectors.select("node", "v").mapInArrow(run, schema)


def _near(codes: np.ndarray, probe: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of a bucket have another within the Hamming radius; rows that are there by a flipped bit alone don't meet each other."""
    out, own = np.zeros(len(codes), bool), np.flatnonzero(~probe)
    for k in range(0, len(own), B.STRIP):
        rows = own[k : k + B.STRIP]
        hit = B.within(codes[rows], codes, radius)
        hit[np.arange(len(rows)), rows] = False
        out[rows] |= hit.any(axis=1)
        out |= hit.any(axis=0)
    return out


def _filtered(entries: DataFrame, indexes: Indexes) -> DataFrame:
    """(bucket, a, b, is_left, probe, node) for the rows (bucket, probe, node, code) of buckets of up to blocks.BLOCK rows that have another row of the bucket within the Hamming radius."""
    shared = entries.sparkSession.sparkContext.broadcast(indexes)
    schema = pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("is_left", pa.bool_()), ("probe", pa.bool_()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in B.groups(batches, ["bucket"]):
            if g.num_rows > 1:
                bucket, probe = g.column("bucket")[0].as_py(), g.column("probe").to_numpy()
                radius = shared.value.radius(bucket)
                keep = np.ones(g.num_rows, bool) if radius >= B.ANY else _near(B.unpacked(g.column("code"), np.uint64), probe, radius)
                if keep.any():
                    n = int(keep.sum())
                    zero = pa.array(np.zeros(n, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket)), zero, zero, pa.array(np.ones(n, bool)), pa.array(probe[keep]), pa.array(g.column("node").to_numpy()[keep])], schema=schema)

    sorted_ = entries.select("bucket", "probe", "node", "code").repartition("bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(run, "bucket long, a long, b long, is_left boolean, probe boolean, node long")


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Brings the classes of i and j together, pair by pair; label has each place's root, the smallest of its class."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _compare(g: pa.Table, radius: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the vectors of one block or of two: nodes, how many vectors each links to that no earlier table, and no smaller bucket of this one, has put beside it, and the smallest place it reaches here."""
    bucket, within = g.column("bucket")[0].as_py(), g.column("a")[0] == g.column("b")[0]
    node, w, probe, left = (g.column(c).to_numpy() for c in ("node", "w", "probe", "is_left"))
    u = _unit(_rows(g.column("v").combine_chunks())[0].reshape(len(node), -1))
    t, key = bucket >> 31 & 127, bucket & 0x7FFFFFFF
    codes, keys = B.unpacked(g.column("code"), np.uint64), B.unpacked(g.column("keys"), np.uint32)
    own, flip = np.split(keys, 2, axis=1)
    count, label = np.zeros(len(node), np.int64), np.arange(len(node))
    both = np.arange(len(node))
    for rows, others in ((both, both),) if within else ((np.flatnonzero(left), np.flatnonzero(~left)),):
        for k in range(0, len(rows), B.STRIP):
            r = rows[k : k + B.STRIP]
            hit = u[r] @ u[others].T >= threshold
            hit &= ~(probe[r][:, None] & probe[others][None])
            i, j = np.nonzero(hit)
            i, j = r[i], others[j]
            if within:
                i, j = i[i < j], j[i < j]
            if keys.shape[1] and len(i):
                fine = np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1, dtype=np.int32) <= radius
                fine &= ~B.retrieved(own[i, :t], flip[i, :t], own[j, :t], flip[j, :t]).any(axis=1)
                two = (own[i, t] == flip[j, t]) & (flip[i, t] == own[j, t])
                fine &= ~two | (np.minimum(own[i, t], own[j, t]) == key)
                i, j = i[fine], j[fine]
            count += (np.bincount(i, w[j], len(node)) + np.bincount(j, w[i], len(node))).astype(np.int64)
            _merge(label, i, j)
    return node, count, node[label]


def links(nodes: DataFrame, indexes: Indexes, threshold: float = 0.9) -> DataFrame:
    """(node, n, to): partial counts of links and edges, for vectors (node, w, v) that are distinct.

    Rows of codes meet in the tables' buckets. In a bucket of up to blocks.BLOCK rows those without another one within the Hamming radius leave;
    larger buckets are dealt out in pairs of blocks as they are. Only then do vectors come, to what is left, and are compared by their cosine in double precision inside the
    tasks: counts and a spanning forest leave a task, pairs don't. A pair counts in the first table and bucket that has it.
    """
    coded = cut(_coded(nodes, indexes))
    entries = coded.select("node", "code", F.size("buckets").alias("all"), F.posexplode("buckets").alias("pos", "bucket")).select("node", "code", "bucket", (2 * F.col("pos") >= F.col("all")).alias("probe"))
    entries = entries.withColumn("probe", F.col("probe") & (F.length("code") > 0))
    marked = B.marked(entries)
    met = _filtered(marked.where("blocks is null"), indexes).unionByName(B.dealt(marked.where("blocks is not null")).drop("code"))
    vectors = nodes.join(coded.select(rekeyed(F.col("node")).alias("node"), "code", "keys"), "node")
    met = met.join(vectors.select(rekeyed(F.col("node")).alias("node"), "w", "v", "code", "keys"), "node")
    shared = nodes.sparkSession.sparkContext.broadcast(indexes)
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])
    group = ["bucket", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in B.groups(batches, group):
            if g.num_rows > 1:
                x = _compare(g, shared.value.radius(g.column("bucket")[0].as_py()), threshold)
                if x[1].any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[x[1] > 0]) for c in x], schema=out)

    return met.select(*group, "is_left", "probe", "node", "w", "code", "keys", "v").repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "node long, n long, to long")


def _lowest(nodes: DataFrame, n: int, sample: int) -> pa.ChunkedArray:
    """The vectors of the `sample` nodes (h1, h2, v) of n that hash lowest: tasks send those below a threshold that so many are below, and few more."""
    part = (1.1 * sample + 10 * math.sqrt(sample) + 20) / max(n, 1)
    near = nodes.where(F.col("h1") < int(-(2**63) + part * 2**64)) if part < 1 else nodes
    got = near.select("h1", "h2", "v").toArrow()
    return got.take(pa.compute.sort_indices(got, [("h1", "ascending"), ("h2", "ascending")])[:sample]).column("v")


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.97, sample: int = 20_000) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    n_links counts the other rows at a cosine of threshold or more that were found, component_id is the smallest id reachable over such
    links, kept is whether it is the row's own. All rows are indexed and all buckets compared whole. The rotations are learnt from
    at most `sample` distinct vectors (those whose contents hash lowest), which bounds what the driver gets and broadcasts; bits, tables and Hamming radius are
    what pairs of that sample need to be found at the rate `recall`. Vectors of each length are indexed by themselves and link with
    each other. Equal vectors are one node with a weight, told apart by 128-bit hash. Rows whose vector is null, empty, zero, or holds
    a null or non-finite component, link with nothing and are their own component. Null ids are ignored in the minimum;
    repeated rows link with each other; an empty table gives no rows; other columns are not read.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    ok = F.coalesce(fine, F.lit(False))
    hashed = rows.select("id", "v", F.when(ok, F.xxhash64("v")).alias("h1"), F.when(ok, F.xxhash64(F.lit(1), "v")).alias("h2"))
    nodes = hashed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("w"), F.first("v").alias("v"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    got = _lowest(nodes, n, sample)
    indexes = fit_all([_unit(np.array(v.values, np.float64)[None])[0] for v in got] if n else [], n, threshold, recall)
    found = cut(links(nodes.select("node", "w", "v"), indexes, threshold))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    label = connected_components(found.select("node", "to"), "node", "to").select("node", "component")
    info = nodes.select("node", "h1", "h2", "first_id", "w").join(counts, "node", "left").join(label, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = info.groupBy("root").agg(F.min("first_id").alias("component_id")).select(rekeyed(F.col("root")).alias("root"), "component_id")
    info = info.join(least, "root").select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("links"), "component_id")
    out = hashed.select("id", "h1", "h2").join(info, (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")), "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op6_embedding_near_dedup": op6_embedding_near_dedup}
ORACLES: dict[str, str] = {}
