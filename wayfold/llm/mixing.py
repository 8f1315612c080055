"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, pseudorandom index permutations. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let, table, unused
from .quality_rules import words

WEIGHTS = (3, 1, 2)
SEED = 20_240_601


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 64) -> DataFrame:
    """One row per source of sizes (source, size): source, rank, source_size, target, n_blocks, quota.

    Sources rank by code point, null last, and have the weights in turn. Targets share share * all sizes by weight; a target stops at
    most * its source's size and the excess is shared again by weight, until none is above. That ends where all sources whose
    limit lies below level * weight have their limit, and the others level * weight: in the order of limit / weight the former
    come first, so running sums give the level. quota is the target in blocks.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights))).withColumn("limit", most * F.col("source_size"))
    order = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    left = F.sum(F.col("source_size")).over(W.partitionBy()) * share - F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("place", F.row_number().over(order)).withColumn("free", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("place")))
    level = F.coalesce(F.min(F.when(F.col("free").isNotNull(), F.struct("place", "level"))).over(W.partitionBy()).level, F.lit(float("inf")))
    s = s.withColumn("target", F.least(F.col("limit"), level * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * blocks / F.col("source_size")), F.floor(most * blocks))).otherwise(0).cast("long")
    return s.select("source", "rank", "source_size", "target", blocks.alias("n_blocks"), quota.alias("quota"))


#: Rows of the tables with one row for each source that are broadcast at most.
SMALL = 50_000
#: Buckets whose sums are added up in one task.
BUCKETS = 4096


def running_before(df: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of the same key before this one, by bucket (a long) and then by order. First over the sums of groups of BUCKETS buckets, then over those of a group's buckets, then in each bucket, so no task has all of a key's rows or buckets."""
    ahead = lambda v, *by: F.coalesce(F.sum(v).over(by[0].rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = df.groupBy(key, bucket).agg(F.sum(value).alias("_sum")).withColumn("_group", F.expr(f"{bucket} div {BUCKETS}"))
    groups = totals.groupBy(key, "_group").agg(F.sum("_sum").alias("_gsum"))
    groups = groups.select(key, "_group", ahead("_gsum", W.partitionBy(key).orderBy("_group")).alias("_upper"))
    totals = totals.withColumn("_lower", ahead("_sum", W.partitionBy(key, "_group").orderBy(bucket)))
    before = totals.join(groups, [key, "_group"]).select(key, bucket, (F.col("_lower") + F.col("_upper")).alias("_before"))
    inside = ahead(value, W.partitionBy(key, bucket).orderBy(*order))
    return df.withColumn("_inside", inside).join(before, [key, bucket]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def permuted(i: Column, n: Column, *key: Column, rounds: int = 16) -> Column:
    """Where a pseudorandom permutation of 0..n-1 sends i. Each round pairs x with K - x (mod n) and a hash of the pair decides whether to swap, so it is a permutation for any n, with no table."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(1), r, *key), n) - x, n)
        return let(partner, lambda p: F.when(F.xxhash64(F.lit(2), r, *key, F.greatest(x, p)).bitwiseAND(F.lit(1)) == 1, p).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, step)


def pack(rows: DataFrame, block: int, rows_per_bucket: int = 4096) -> DataFrame:
    """rows (id, rank, size > 0, apart if there) with start: the place of a document's first word in its source's sequence of words. The sequence is cut every `block` words."""
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id", *(c for c in ("size", "apart") if c in rows.columns)), F.lit(buckets)).cast("long"))
    return running_before(dealt, "rank", "bucket", ["id", *(c for c in ("size", "apart") if c in dealt.columns)], "size", "start").drop("bucket")


def pieces(packed: DataFrame, block: int) -> DataFrame:
    """The parts of documents in blocks: packed's columns, block, at (the part's first word in the document) and n (its words)."""
    first = F.col("start")
    cut_up = packed.withColumn("block", F.explode(F.sequence(F.floor(first / block), F.floor((first + F.col("size") - 1) / block))))
    at = F.greatest(F.col("block") * block - first, F.lit(0))
    return cut_up.withColumn("at", at).withColumn("n", F.least((F.col("block") + 1) * block - first, F.col("size")) - F.col("at"))


def draw_slots(plan: DataFrame, seed: int = SEED, slots_per_shard: int = 8192, slots_per_task: int = 500_000) -> DataFrame:
    """(shard, slot, rank, block): the block of which source fills each slot of the output.

    The output has as many slots as the quotas sum to, slots_per_shard to a shard. Each slot draws its source with probability
    quota / slots (a number below the sum of quotas, looked up in bins of that range, about two sources to a bin), so a shard's source counts are multinomial. The j-th slot of a source takes block permuted(j mod n_blocks), by a permutation
    of its own for each pass over the source; slots drawn beyond a source's quota go, in order, to the sources that were drawn too
    seldom, so that every quota is met exactly and no block is taken more often than passes allow. Hashes of the slot number
    are all the randomness: reruns agree.
    """
    spark = plan.sparkSession
    n_slots, n_sources = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if n_sources <= SMALL else lambda df: df
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_slots // slots_per_task))
    spans = plan.where("quota > 0").withColumn("upto", F.sum("quota").over(W.orderBy("rank"))).withColumn("from", F.col("upto") - F.col("quota"))
    size = max(1, n_slots // max(64, n_sources))
    spans = spans.select("rank", "quota", "from", "upto", F.explode(F.sequence(F.expr(f"from div {size}"), F.expr(f"(upto - 1) div {size}"))).alias("bin"))
    slots = spark.range(0, n_slots, 1, tasks).select(F.expr(f"id div {slots_per_shard}").alias("shard"), F.col("id").alias("slot"))
    slots = slots.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(1, n_slots)).cast("long"))).withColumn("bin", F.expr(f"u div {size}"))
    drawn = slots.join(small(spans), "bin").where("u >= from and u < upto").select("shard", "slot", "rank", "quota", F.lit(1).cast("long").alias("one"))
    numbered = cut(running_before(drawn, "rank", "shard", ["slot"], "one", "j").select("shard", "slot", "rank", "j", F.col("j") >= F.col("quota"), "one").toDF("shard", "slot", "rank", "j", "over", "one"))
    over = running_before(numbered.where("over").withColumn("all", F.lit(0)), "all", "shard", ["slot"], "one", "o").select("shard", "slot", "o")
    counts = plan.where("quota > 0").select("rank", "quota").join(numbered.groupBy("rank").agg(F.count("*").alias("got")), "rank", "left")
    lack = F.greatest(F.col("quota") - F.coalesce("got", F.lit(0)), F.lit(0))
    short = counts.withColumn("lack", lack).withColumn("before", F.coalesce(F.sum("lack").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("lack > 0")
    short = short.select("rank", "got", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("x"))
    refilled = over.join(short.select("rank", (F.col("before") + F.col("x")).alias("o"), (F.coalesce("got", F.lit(0)) + F.col("x")).alias("j")), "o").select("shard", "slot", "rank", "j")
    filled = numbered.where("not over").select("shard", "slot", "rank", "j").unionByName(refilled).join(small(plan.select("rank", "n_blocks")), "rank").repartition(tasks, "slot")
    turn = F.expr("j div n_blocks")
    return filled.select("shard", "slot", "rank", permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("rank"), turn).alias("block"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = SEED, apart: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, parts, slots) of the mix of docs.

    rows: id, source, size (words of the text), rank, source_size, target. parts: id, rank, start, size, block, at, n, times: the parts
    of documents with words, and how many slots take each. slots: shard, slot, rank, block. Joining parts and slots by rank and block gives the output blocks.

    Null and empty texts have size 0 and no parts; sources without words get no slots; a null source is the last source; null and
    repeated ids are rows as any other (their order in a source's sequence is by id and size; equal rows are interchangeable; apart
    names a column that tells rows of one id apart, which rows and parts then have as `apart`); an
    empty table gives no rows. Other columns are not read. Blocks are what is taken, so a source's words come near its target to half a block, and a source
    smaller than a block is taken 0, 1 or 2 times as a whole. One row per source goes through a single task; nothing else does.
    """
    more = [] if apart is None else [F.col(apart).alias("apart")]
    base = cut(docs.select(F.col(id_col).alias("id"), *more, F.col(source_col).cast("string").alias("source"), F.coalesce(F.size(words(F.col(text_col))), F.lit(0)).cast("long").alias("size")).withColumn("size", F.greatest("size", F.lit(0).cast("long"))))
    plan = cut(source_plan(base, weights, share, most, block))
    named = plan.select(F.col("source").alias("s"), "rank", "source_size", "target")
    named = F.broadcast(named) if named.count() <= SMALL else named
    rows = base.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    slots = cut(draw_slots(plan, seed))
    takes = slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    parts = pieces(pack(rows.where("size > 0").select("id", *(["apart"] if more else []), "rank", "size"), block), block)
    return rows, parts.join(takes, ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0))), slots


def taken_words(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken."""
    taken = parts.groupBy("id", "rank", "start", "size").agg(F.sum(F.col("n") * F.col("times")).alias("taken")).select("id", "rank", "size", "taken")
    taken = taken.unionByName(rows.where("size = 0").select("id", "rank", "size", F.lit(0).cast("long").alias("taken")))
    return taken.join(rows.select("rank", "source_size", "target").distinct(), "rank")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents with all columns of docs: a row for the first taking of a document's parts and one for the second, with the text of those parts, each word with the white space before it; whole where all parts are taken.

    Rows are told apart by id, source and text (by hash), so rows that only share an id are mixed each by its own text; rows equal in the
    three are each taken as the slots say, with the other columns of any one of them. Texts without words are not taken.
    """
    key, t_key, turn = (unused(docs, n) for n in ("_key", "_of", "_turn"))
    parts_of_key = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, source_col))
    keyed = docs.withColumn(key, F.concat_ws(":", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).cast("string"), F.col(id_col).isNull().cast("int").cast("string"), F.col(source_col).isNull().cast("int").cast("string"), *parts_of_key))
    _, parts, _ = mix(keyed, id_col, text_col, source_col, apart=key)
    passes = parts.where("times > 0").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    got = passes.groupBy("apart", "rank", "start", "size", "turn").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("got"), F.sum("n").alias("n"))
    got = got.select(F.col("apart").alias(t_key), F.struct("size", "n", "got").alias(turn))
    joined = keyed.dropDuplicates([key]).join(got, F.col(key) == F.col(t_key))
    ws = F.regexp_extract_all(text_col, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    text = let(ws, lambda w: F.array_join(F.transform(F.col(turn).got, lambda p: F.array_join(F.slice(w, (p["at"] + 1).cast("int"), p["n"].cast("int")), "")), ""))
    return joined.withColumn(text_col, F.when(F.col(turn).n == F.col(turn)["size"], F.col(text_col)).otherwise(text)).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts, _ = mix(table(spark, sf_dir, "documents"))
    return taken_words(rows, parts).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op4_mixing": op4_mixing}
ORACLES: dict[str, str] = {}
