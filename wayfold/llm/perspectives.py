"""Chat formatting by perspective: a dialogue once for each participant, that speaker as assistant and the others as named users. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, table

#: Turn numbers that one part of a dialogue spans, and turns that one piece of a part has at most.
PART = 64
SYSTEM = "system"


def _head(role: Column, me: Column) -> Column:
    name = F.replace(F.replace(F.replace(F.url_encode(role), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    label = F.when(role == me, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user"), F.coalesce(F.concat(F.lit(" name="), name), F.lit(""))))
    return F.concat(F.lit("<|start|>"), label, F.lit("\n"))


def _rendered(turns: Column, me: Column) -> Column:
    """text and spans of turns (role, body) as `me` sees them."""

    def one(t: Column) -> Column:
        head = _head(t.role, me)
        return F.struct(head.alias("head"), t.body.alias("body"), F.length(head).alias("h"), (F.length(head) + F.length(t.body)).alias("n"), F.coalesce(t.role == me, F.lit(False)).alias("own"))

    def both(r: Column) -> Column:
        before = lambda k: F.aggregate(F.slice(r, F.lit(1), k), F.lit(0), lambda a, x: a + x.n)
        at = F.transform(r, lambda x, k: F.struct(x.own.alias("own"), (before(k) + x.h).alias("begin"), (before(k) + x.n).alias("end")))
        spans = F.transform(F.filter(at, lambda s: s.own), lambda s: F.struct(s.begin.alias("begin"), s.end.alias("end")))
        return F.struct(F.array_join(F.transform(r, lambda x: F.concat(x.head, x.body)), "").alias("text"), spans.alias("spans"))

    return let(F.transform(turns, one), both)


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, part, piece, n_turns, text, spans): each dialogue as each of its participants sees it.

    Participants are a conversation's speakers (role) but for "system", which stays what it is in every rendering. A turn is
    `<|start|>label`, a line end, its text, `<|end|>` and a line end; the label is assistant for the participant, `user name=...` for the
    others (percent-encoded, so that different speakers have different names), user for a null speaker. `<|` in a text becomes `< |`, so texts hold no markers. spans has begin and end, in
    code points of text, of what is to be learnt: the participant's own texts with their end markers.

    A dialogue's rows, in the order of part and piece, make it up: a part has the turns of PART turn numbers, a piece PART turns
    at most, so no row or group grows with the conversation, and each turn is moved once, whatever the number of participants. Ties of turn
    numbers are ordered by speaker and then text with its end marker, nulls first; null texts are empty; null turn numbers come first, as a part of their own (null); a
    null conv_id is a conversation; repeated rows are turns; conversations without participants and empty tables give no
    rows; other columns are not read.
    """
    body = F.concat(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<\|", "< |"), F.lit("<|end|>\n"))
    t = turns.select(F.struct(F.col(conv_col).alias("conv_id")).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), body.alias("body")).withColumn("part", F.floor(F.col("turn") / PART).cast("long"))
    t = t.withColumn("place", F.struct("conv", "part"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("body").asc()]
    t = t.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy(*order)) - 1).withColumn("piece", F.floor(F.col("rank") / PART).cast("long"))
    pieces = t.groupBy("place", "piece").agg(F.sort_array(F.collect_list(F.struct("rank", "role", "body"))).alias("turns"))
    seen = turns.select(F.struct(F.col(conv_col).alias("conv_id")).alias("conv"), F.floor(F.col(turn_col) / PART).cast("long").alias("part"), F.col(role_col).cast("string").alias("role"))
    speakers = seen.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select("conv", F.col("role").alias("speaker")).distinct()
    places = seen.select("conv", "part").distinct().select(F.col("conv").alias("of"), F.struct("conv", "part").alias("at"))
    views = places.join(speakers, F.col("of") == F.col("conv")).select("at", "speaker")
    out = pieces.join(views, F.col("place") == F.col("at"))
    out = out.select(F.col("place.conv.conv_id").alias("conv_id"), "speaker", F.col("place.part").alias("part"), "piece", F.size("turns").cast("long").alias("n_turns"), _rendered(F.col("turns"), F.col("speaker")).alias("r"))
    return out.select("conv_id", "speaker", "part", "piece", "n_turns", "r.text", "r.spans")


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.begin, s.end)), ","))


QUERIES = {"op7_perspectives": op7_perspectives}
ORACLES = {
    "op7_perspectives": r"""
WITH t AS (
  SELECT conv_id, floor(turn / 64)::BIGINT AS part, turn, role, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body FROM conversations
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role NULLS FIRST, body) - 1 AS rank FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
v AS (
  SELECT r.conv_id, speaker, part, rank // 64 AS piece, rank, body, coalesce(role = speaker, false) AS own,
    '<|start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' WHEN role IS NULL THEN 'user'
      ELSE 'user name=' || url_encode(role) END || chr(10) AS head
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY rank) AS upto FROM v
)
SELECT conv_id, speaker, part, piece, count(*) AS n_turns, string_agg(head || body, '' ORDER BY rank) AS text,
  coalesce(string_agg((upto - length(body))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY rank) FILTER (WHERE own), '') AS spans
FROM p GROUP BY conv_id, speaker, part, piece""",
}
