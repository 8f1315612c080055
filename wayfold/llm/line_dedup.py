"""Line dedup: two Bloom filters find the suspected repeats; only those shuffle, to be confirmed exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACE_BYTES, cut, flushed, table

#: Bits of a block of the filters, and hash positions of a key in its block.
BLOCK_BITS, POSITIONS = 1 << 16, 4


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line without ASCII white space at its ends and with A-Z lower-cased; None if it has fewer than min_chars code points."""
    key = line.strip(SPACE_BYTES)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, keys): the distinct keys of each document, 16 bytes each, end to end."""
    schema = docs.select("id", F.lit(b"").alias("keys")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    text = t.as_py() or b""
                    yield i, b"".join({k for line in text.split(b"\n") if (k := line_key(line, min_chars))})

        return flushed(rows(), arrow, lambda r: len(r[1]) + 8)

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _places(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Bit numbers (n, POSITIONS) of keys, given as (n, 2) unsigned longs: all in one block of the filter."""
    inner = np.stack([keys[:, 1] >> np.uint64(16 * i) & np.uint64(BLOCK_BITS - 1) for i in range(POSITIONS)], 1)
    return (keys[:, :1] % np.uint64(blocks) * np.uint64(BLOCK_BITS) + inner).astype(np.int64)


class Filters:
    """Once-seen and twice-seen Bloom filters. What was seen twice is in the second for sure; few others are."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.once, self.twice = (np.zeros(blocks * BLOCK_BITS // 8, np.uint8) for _ in range(2))

    @staticmethod
    def has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)

    @staticmethod
    def put(bits: np.ndarray, places: np.ndarray) -> None:
        flat = places.ravel()
        np.bitwise_or.at(bits, flat >> 3, np.uint8(1) << (flat & 7).astype(np.uint8))

    def add(self, keys: np.ndarray) -> None:
        distinct, n = np.unique(keys, axis=0, return_counts=True)
        places = _places(distinct, self.blocks)
        self.put(self.twice, places[(n > 1) | self.has(self.once, places)])
        self.put(self.once, places)


def _packed(bits: np.ndarray) -> bytes:
    """A block's bits: the places of those that are set while they are few (2 bytes each), else all."""
    set_ = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    return set_.astype("<u2").tobytes() if 2 * len(set_) < len(bits) else bits.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == BLOCK_BITS // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[np.frombuffer(data, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


_FILTER_ROWS = "block long, once binary, twice binary"
_FILTER_ARROW = pa.schema([("block", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def _twice_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, once, twice) over all rows of keys. Each task fills filters of its own; these meet block by block, where what two tasks saw once each counts as seen twice."""
    size = BLOCK_BITS // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(blocks)
        for b in batches:
            data = b"".join(b.column(0).to_pylist())
            if data:
                f.add(np.frombuffer(data, "<u8").reshape(-1, 2))
        used = np.flatnonzero(f.once.reshape(blocks, size).any(axis=1))
        rows = ((int(i), _packed(f.once[i * size : (i + 1) * size]), _packed(f.twice[i * size : (i + 1) * size])) for i in used)
        yield from flushed(rows, _FILTER_ARROW, lambda r: len(r[1]) + len(r[2]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, once, twice = None, None, None
            for b in batches:
                for block, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    o, t = _unpacked(o), _unpacked(t)
                    if block == at:
                        once, twice = once | o, twice | t | (once & o)
                    else:
                        if at is not None:
                            yield at, once.tobytes(), twice.tobytes()
                        at, once, twice = block, o, t
            if at is not None:
                yield at, once.tobytes(), twice.tobytes()

        return flushed(rows(), _FILTER_ARROW, lambda r: 2 * size)

    partial = keys.select("keys").mapInArrow(fill, _FILTER_ROWS)
    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(meet, _FILTER_ROWS)


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits_per_key: int = 8, max_filter_bytes: int = 128 << 20) -> DataFrame:
    """(id, drop): for each id of docs (id, text) that loses lines, the 16-byte hashes of those lines.

    A key of at least min_chars code points that min_docs rows or more hold is dropped except from the largest id holding it
    (null is the smallest). The filters have bits_per_key bits for each key of a document, max_filter_bytes at most: that bound,
    for what each worker holds, is the same at every corpus size. Beyond it the twice-seen filter fills up and more lines become
    suspects; the result stays exact, as every suspect is confirmed by its 128-bit hash.
    """
    spark = docs.sparkSession
    keys = cut(_keys(docs, min_chars))
    n = keys.agg(F.sum(F.length("keys"))).first()[0] or 0
    blocks = max(1, min(n // 16 * bits_per_key // BLOCK_BITS + 1, max_filter_bytes * 8 // BLOCK_BITS))
    bits = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for r in _twice_filter(keys, blocks).select("block", "twice").toLocalIterator():  # max_filter_bytes at most
        bits[r.block] = np.frombuffer(r.twice, np.uint8)
    twice = spark.sparkContext.broadcast(bits.reshape(-1))
    schema = keys.select("id", F.lit(b"").alias("key")).schema
    arrow = to_arrow_schema(schema)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            flat = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 16)
            if len(flat):
                at = np.flatnonzero(Filters.has(twice.value, _places(flat.view("<u8"), blocks)))
                owner = np.repeat(np.arange(len(data)), [len(x) // 16 for x in data])[at]
                for k in range(0, len(at), 1 << 16):
                    ids = b.column(0).take(pa.array(owner[k : k + (1 << 16)]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in flat[at[k : k + (1 << 16)]]], pa.binary())], schema=arrow)

    suspects = cut(keys.mapInArrow(suspected, schema))
    found = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    # not the grouped column itself: then both sides are exchanged, and adaptive execution can split a very common line's rows
    found = found.select(F.concat(F.col("key"), F.lit(b"")).alias("key"), "last")
    return suspects.join(found, "key").where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id").agg(F.collect_set("key").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, text, n_lines, n_dropped) and the carried columns as a struct `carried`, for each row of docs.

    text is what is left of the lines (split at \\n), joined by \\n; n_lines counts them before dropping. Null and empty texts have one
    empty line and become the empty text. Rows that share an id are documents of their own when holders are counted, and all keep
    a line whose largest holder they are; so do null ids if no other holds it. An empty table gives no rows. Columns that are
    neither named nor carried are not read, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _carried(carry))
    drops = repeated_lines(rows.select("id", "text"), min_chars, min_docs).withColumnRenamed("id", "drop_id")
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("drop_id")), "left")
    kind = rows.schema["id"].dataType.simpleString(), rows.schema["carried"].dataType.simpleString()
    schema = f"id {kind[0]}, text binary, n_lines long, n_dropped long, carried {kind[1]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts, lines, dropped = [], [], []
                for t, d in zip(part.column(1), part.column(2), strict=True):
                    all_ = (t.as_py() or b"").split(b"\n")
                    drop = set(d.as_py() or ())
                    kept = [x for x in all_ if line_key(x, min_chars) not in drop] if drop else all_
                    texts.append(b"\n".join(kept))
                    lines.append(len(all_))
                    dropped.append(len(all_) - len(kept))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), part.column(3)], ["id", "text", "n_lines", "n_dropped", "carried"])

    out = joined.select("id", F.col("text").cast("binary").alias("text"), "drop", "carried").mapInArrow(run, schema)
    return out.withColumn("text", F.col("text").cast("string"))


def _carried(carry: tuple[str, ...]) -> Column:
    return (F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))).alias("carried")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key AND l.doc_id <> c.last
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
