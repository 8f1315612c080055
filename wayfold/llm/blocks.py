"""Blocks of binary codes: tables keyed by a code's substrings, searched at radius 1 in the direction of each substring's least certain bit, and rows that meet in a table's buckets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rekeyed

#: Rows of a bucket that one task compares at a time; larger buckets are split into blocks, and each pair of blocks is a task's work.
BLOCK = 4096
#: A shuffled row costs about as much as so many comparisons of codes.
ROW_COST = 256
#: Bits of a code at least; what the tables' substrings don't use serves the Hamming test alone.
CODE_BITS = 128
#: Buckets above BLOCK rows that are broadcast at most; more are joined by exchange.
HOT_BUCKETS = 50_000
#: Rows of a matrix of comparisons that is held at once.
STRIP = 256
#: A radius that any two codes are within.
ANY = 1 << 30


def words(x: np.ndarray) -> np.ndarray:
    """The signs of x (n, bits), as 64-bit words."""
    return np.packbits(x > 0, axis=1, bitorder="little").view(np.uint64)


def keys(x: np.ndarray, tables: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (n, tables): the signs of width columns of x each; and the same with the sign that is nearest to none flipped."""
    if not width:
        return np.zeros((len(x), 0), np.uint32), np.zeros((len(x), 0), np.uint32)
    parts = x[:, : tables * width].reshape(len(x), tables, width)
    own = ((parts > 0) @ (1 << np.arange(width, dtype=np.int64))).astype(np.uint32)
    return own, own ^ (np.uint32(1) << np.abs(parts).argmin(axis=2).astype(np.uint32))


def buckets(own: np.ndarray, flipped: np.ndarray, slot: int = 0) -> np.ndarray:
    """(n, 2 * tables) bucket numbers, made of slot, table and key: those of the keys, then those of the flipped ones."""
    tables = np.arange(own.shape[1], dtype=np.int64) << 31 | slot << 38
    return np.hstack([tables | own, tables | flipped])


def retrieved(own_a: np.ndarray, flip_a: np.ndarray, own_b: np.ndarray, flip_b: np.ndarray) -> np.ndarray:
    """Whether two rows meet, table by table: one's key is the other's, or what the other has with a bit flipped."""
    return (own_a == own_b) | (own_a == flip_b) | (flip_a == own_b)


def _least_tables(kinds: int, more: Callable, width: int, recall: float, most: int) -> int | None:
    missed: list[np.ndarray | None] = [None] * kinds
    for t in range(most):
        worst, s = 1.0, slice(t * width, (t + 1) * width)
        for k, (a, b) in enumerate(more((t + 1) * width)):
            miss = ~retrieved(*keys(a[:, s], 1, width), *keys(b[:, s], 1, width))[:, 0]
            missed[k] = miss if missed[k] is None else missed[k] & miss
            worst = min(worst, 1 - float(missed[k].mean()))
        if worst >= recall:
            return t + 1
        if t == 7 and 1 - (1 - worst) ** (most / 4) < recall:
            return None
    return None


def plan(n: int, kinds: int, more: Callable[[int], list[tuple[np.ndarray, np.ndarray]]], recall: float, most: int = 64) -> tuple[int, int, int, int] | None:
    """(tables, width, bits, radius) for n codes: what costs least of all that finds pairs at this rate.

    more(bits) gives, for each of so many kinds of pairs that are to be found, both ends' values before signs are taken, in so many columns at least. Tables are counted
    until each kind's pairs are found at the rate, a little above it for what the Hamming radius loses; that lets 99.5 % of them
    pass. None: no such tables, up to `most`, compare fewer pairs than there are.
    """
    best: tuple[float, int, int] | None = None
    for width in range(min(30, max(4, math.ceil(math.log2(max(n, 2) / 8)))), 3, -1):
        if best is not None and 1.5 * n / 2**width > best[0]:
            break
        t = _least_tables(kinds, more, width, recall + (1 - recall) / 3, most)
        if t is not None:
            compared = 1.5 * t * n / 2**width
            cost = 2 * t * ROW_COST + compared
            if compared < n / 2 and (best is None or cost < best[0]):
                best = (cost, t, width)
    if best is None:
        return None
    _, t, width = best
    bits = max(CODE_BITS, -(-t * width // 64) * 64)
    far = max(float(np.quantile(((a[:, :bits] > 0) != (b[:, :bits] > 0)).sum(axis=1), 0.995)) for a, b in more(bits))
    return t, width, bits, math.ceil(far)


def marked(entries: DataFrame) -> DataFrame:
    """entries (bucket, …) with blocks: into how many the bucket is to be split, null where it has up to BLOCK rows."""
    hot = cut(entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    n = hot.count()
    if not n:
        return entries.withColumn("blocks", F.lit(None).cast("long"))
    side = F.broadcast(hot) if n <= HOT_BUCKETS else hot.select(rekeyed(F.col("bucket")).alias("bucket"), "blocks")
    return entries.join(side, "bucket", "left")


def dealt(marked_: DataFrame) -> DataFrame:
    """(…, a, b, is_left) for rows of marked entries with a node: a row for each pair of blocks (a <= b) of its bucket that its own is in; is_left: that is a."""
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    out = marked_.withColumn("mine", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return out.withColumns({"a": F.least("mine", "other"), "b": F.greatest("mine", "other"), "is_left": F.col("mine") <= F.col("other")}).drop("mine", "other", "blocks")


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, group by group."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        ids = np.stack([held.column(c).to_numpy() for c in by], 1)
        cuts, at = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, 0
        for c in cuts:
            yield held.slice(at, c - at)
            at = c
        held = held.slice(at)
    if held is not None:
        yield held


def unpacked(col: pa.ChunkedArray, kind: type) -> np.ndarray:
    """A binary column as rows of numbers."""
    data = col.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of codes (n, words), (m, words) differ in up to radius bits."""
    return np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2, dtype=np.int32) <= radius
