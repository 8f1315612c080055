"""Quality rules: word, symbol and repetition counts, and cross-document line frequency. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, let, rekeyed, table, unused

WINDOW = 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words in windows of so many words that the text has twice or more, the first ones included. Windows are told apart by 64-bit hash."""
    starts = F.sequence(F.lit(0), F.size(ws) - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i + 1, window)))

    def covered(at: Column) -> Column:
        ahead = F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window))))
        return F.aggregate(ahead, F.lit(0), lambda a, b: a + b)

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k).h == x.h, F.lit(False))
        found = let(pairs, lambda s: F.transform(F.filter(s, lambda x, k: same(s, x, k + 1) | (F.when(k > 0, same(s, x, k - 1)).otherwise(F.lit(False)))), lambda x: x.i))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(found), covered))

    return F.when(F.size(ws) > window, let(hashes, repeated)).otherwise(F.lit(0)).cast("long")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _line_key(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per row of docs: id, host, content (hash of the text), the counts of the contract, and the keys and word counts of its lines with a word."""
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = base.select("id", "host", "text", F.xxhash64("text").alias("content"), words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    return split.select(
        "id",
        "host",
        "content",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", _line_key).alias("line_keys"),
        F.transform("lines", lambda x: F.size(words(x))).alias("line_words"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 5, max_share: float = 0.05, always_docs: int = 5000, min_words: int = 20, min_left: float = 0.5, copies: bool = True) -> DataFrame:
    """One row per row of docs: id, content, the base counts, base_failed, removed_words, removed_lines (keys), kept.

    A line with a word is normalised (lower case, runs of ASCII white space as one space) and hashed. For each host, the documents (rows)
    that hold it are counted, copies of a text included; copies=False: texts that are equal count as one document. A line in min_docs or more of them
    is removed from all of the host's documents if these are more than max_share of the host's or more than always_docs. A document is
    kept if it doesn't fail the base rules and keeps min_words words and min_left of its words.

    Null texts count as empty (they fail: no word); a null host is a host; rows that share an id, and rows that repeat as a
    whole, are judged each by its text; an empty table gives no rows; other columns are not read. Groups are summed in part before each exchange; the lines' join with the
    frequent lines is one that adaptive execution can split when a host or a line has very many rows. Hashes have 64 bits: a line could only be
    taken for another one by falling on one of its host's few frequent lines.
    """
    rows = cut(measures(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()))
    keys, hosts = rows.select("host", "content", F.explode(F.array_distinct("line_keys")).alias("key")), rows.select("host", "content")
    if not copies:
        keys, hosts = keys.distinct(), hosts.distinct()
    held = keys.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    hosts = hosts.groupBy("host").agg(F.count("*").alias("host_docs"))
    too_many = (F.col("n") > max_share * F.col("host_docs")) | (F.col("n") > always_docs)
    frequent = held.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(too_many).select(F.col("host").alias("h"), rekeyed(F.col("key")).alias("k"))
    lines = rows.select("row", "host", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select("row", "host", F.col("l.line_keys").alias("key"), F.col("l.line_words").alias("n"))
    gone = lines.join(frequent, (F.col("key") == F.col("k")) & F.col("host").eqNullSafe(F.col("h")))
    gone = gone.groupBy("row").agg(F.sum("n").alias("removed"), F.collect_set("key").alias("removed_lines"))
    out = rows.join(gone.select(rekeyed(F.col("row")).alias("g_row"), "removed", "removed_lines"), F.col("row") == F.col("g_row"), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    return out.select(
        "id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "removed_words", F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
        (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def apply_quality_rules(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that the verdict keeps, all their columns, their texts without the removed lines."""
    content, v_id, v_content, v_host, v_lines = (unused(docs, n) for n in ("_content", "_v_id", "_v_content", "_v_host", "_v_lines"))
    v = verdict.where("kept").select(F.col("id").alias(v_id), F.col("content").alias(v_content), F.col("host").alias(v_host), F.col("removed_lines").alias(v_lines)).distinct()
    d = docs.withColumn(content, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = d.join(v, F.col(id_col).eqNullSafe(F.col(v_id)) & (F.col(content) == F.col(v_content)) & F.col(host_col).cast("string").eqNullSafe(F.col(v_host)))
    kept = F.filter(F.split(text_col, "\n"), lambda x: ~x.rlike(WORD) | ~F.array_contains(v_lines, _line_key(x)))
    return joined.withColumn(text_col, F.when(F.size(v_lines) == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
l AS (
  SELECT doc_id, source, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, text, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
freq AS (
  SELECT source, norm FROM l JOIN (SELECT source, count(*) AS host_docs FROM d GROUP BY source) h USING (source)
  GROUP BY source, norm, host_docs HAVING count(DISTINCT doc_id) >= 5 AND (count(DISTINCT doc_id) > 0.05 * host_docs OR count(DISTINCT doc_id) > 5000)
),
gone AS (SELECT doc_id, sum(n)::BIGINT AS removed_words FROM l JOIN freq USING (source, norm) GROUP BY doc_id),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)
),
r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM r GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 20 AND n_words - removed_words >= 0.5 * n_words AS kept
FROM m""",
}
