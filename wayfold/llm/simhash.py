"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, flushed, rekeyed, table, unused
from .components import connected_components

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Blocks of a fingerprint, as bits. Two that differ in at most 2 bits agree in 3 blocks of 5 at least.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of a bucket that are compared pair by pair; larger buckets are linked over midpoints.
PAIRWISE = 64


def _runs(text: bytes, overlap: int, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in runs of about size bytes; each run begins with the last `overlap` words of the one before."""
    at, carried = 0, []
    while at < len(text):
        end = at + size
        if end < len(text):
            end = m.start() if (m := _SPACE.search(text, end)) else len(text)
        words = carried + text[at:end].split()
        at = end
        yield words
        carried = words[-overlap:] if overlap else []


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, words, shingles with repeats, XXH64. A bit is 1 if it is in over half of the hashes. No word: 0; fewer words than a shingle has: one shingle of all of them."""
    counts, total, short = np.zeros(64, np.int64), 0, []
    for words in _runs((text or b"").lower(), shingle - 1):
        if len(words) < shingle:
            short = words
            continue
        short = []
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, joined, repeat(seed))), np.uint8)
        counts += np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        total += len(digests) // 8
    if not total and short:
        return xxhash.xxh64_intdigest(b" ".join(short), seed)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, content: bool = True) -> DataFrame:
    """(id, content, fp): content is a 128-bit hash of the text (null as empty), or null if not asked for, fp the fingerprint as a signed long. Whole texts are hashed, in runs of bounded size."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("content", pa.string()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, c, (f := fingerprint(t, shingle, seed)) - ((f >> 63) << 64)) for b in batches for i, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2)), strict=True))
        return flushed(rows, schema, lambda r: 60)

    return docs.select(F.col(id_col).alias("id"), (_content(text_col) if content else F.lit(None).cast("string")).alias("content"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, content string, fp long")


def _content(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))


def _masks() -> list[int]:
    """The bits of each choice of 3 blocks, as signed longs."""
    at, blocks = 0, []
    for n in BLOCKS:
        blocks.append(((1 << n) - 1) << at)
        at += n
    return [(m := sum(c)) - ((m >> 63) << 64) for c in combinations(blocks, 3)]


def close_pairs(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (one column fp, no repeats) whose components are those of all pairs at 2 bits or fewer.

    Pigeonhole: in one of ten tables, keyed by three blocks of five, such a pair has the same key. In a bucket of up to PAIRWISE
    fingerprints all pairs are checked. The fingerprints of larger buckets meet at midpoints instead: two of them at 2 bits or
    fewer share a value that differs from each in at most one bit, and at most 65 fingerprints are that close to a value. So no
    bucket's pairs are emitted and no link is lost.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks())])
    entries = fps.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    sizes = entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(entries.join(sizes.select("t", rekeyed(F.col("key")).alias("key"), "n"), ["t", "key"]))
    small = met.where(F.col("n") <= PAIRWISE)
    pairs = small.select("t", "key", F.col("fp").alias("a")).join(small.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((i == 63) << 64))) for i in range(64)])
    large = met.where(F.col("n") > PAIRWISE).select("fp").distinct().select("fp", F.explode(near).alias("mid"))
    stars = large.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, content: bool = True) -> DataFrame:
    """(id, content, fp, component_id, root) for each row of docs; root is the smallest fingerprint of the row's group."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle, content=content))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    labels = connected_components(close_pairs(rows.select("fp").distinct()), "a", "b")
    nodes = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = nodes.select("fp", "root").join(least.select(rekeyed(F.col("root")).alias("root"), "component_id"), "root").select(rekeyed(F.col("fp")).alias("fp"), "component_id", "root")
    return rows.join(groups, "fp").select("id", "content", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row of docs.

    component_id is the smallest id among the documents whose fingerprints are reachable over links of 2 bits or fewer.
    Equal fingerprints are one node, however many documents have them. Null ids are ignored in the minimum (all null: null);
    null and empty texts have the fingerprint zero and are linked as any other; repeated rows are kept; an empty table
    gives no rows; other columns are not read.
    """
    return grouped(docs, id_col, text_col, shingle, content=False).select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of docs for each group of near duplicates, with all columns.

    The row with the smallest id stays (null only where a group has no other). Rows that share that id and differ in text: the
    text whose hash is smallest stays; rows equal in id and text: any one. Groups that share an id each keep a row.
    """
    return first_of_each(docs, grouped(docs, id_col, text_col, shingle), id_col, text_col)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that one_of_each keeps of the groups found: (id, content, component_id, root) for each row."""
    first = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id").agg(F.min("content").alias("content"))
    # one key for the join and for equal rows, so that texts are exchanged once; a null id leaves the hash alone
    key, wanted = unused(docs, "key"), unused(docs, "wanted")
    keyed = docs.withColumn(key, F.concat_ws(":", F.col(id_col).cast("string"), _content(text_col)))
    chosen = first.select(F.concat_ws(":", F.col("id").cast("string"), F.col("content")).alias(wanted))
    return keyed.join(chosen, F.col(key) == F.col(wanted), "left_semi").dropDuplicates([key]).select(*docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLES: dict[str, str] = {}
