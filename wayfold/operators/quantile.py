"""Percentiles of groups of any size, by selection: rounds of sketches or counts narrow down where a rank's value lies, and only what lies there is sorted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import cut, free

#: Rows of a group, or of what is left of it, that one task sorts.
MOST = 100_000
#: Cuts that a round's sketch has, and its accuracy: about 1 / CUTS of a group's rows are left after a round.
CUTS, ACCURACY = 500, 5000
#: Rows of brackets that are broadcast; more are joined by exchange.
FEW = 10_000
#: Slices that a round of counted_percentile cuts what is left of a group into; and rows of one that the next round takes value by value.
SLICES, LAST = 64, 256


def _plain(rows: DataFrame, probs: dict[str, float]) -> DataFrame:
    return rows.groupBy("_g").agg(*(F.percentile("_v", p).alias(c) for c, p in probs.items()), F.count("_v").alias("_n"))


def _near(rows: DataFrame, brackets: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the brackets of their group; brackets are few but for very many large groups."""
    b = brackets.select(F.col("_g").alias("_of"), *columns)
    return rows.join(F.broadcast(b) if brackets.count() <= FEW else b, F.col("_g") == F.col("_of")).drop("_of")


_INSIDE = "(_low IS NULL OR _v > _low) AND (_high IS NULL OR _v < _high)"


def order_statistics(rows: DataFrame, ranks: DataFrame, most: int = MOST) -> DataFrame:
    """(_g, _rank, _x): the value of each rank (from 0) of each group. rows: _g, _v (not null), written; ranks: _g, _rank (below the group's size), _n.

    An open rank's value lies strictly between two values, _low and _high, of which the rows up to _low are counted. A round sketches the quantiles of what lies between (sketches are merged, so
    they are bounded), takes the cuts next to the rank, and counts the rows up to these exactly: the rank is at a cut, between two, or, should the sketch have been wrong, beyond them. When at
    most `most` rows are left between, they are sorted. Ties of any number are at a cut, so a round always leaves fewer; the number of rounds grows with the logarithm of the group's size.
    """
    none = F.lit(None).cast("double")
    open_ = cut(ranks.select("_g", "_rank", none.alias("_low"), none.alias("_high"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_left")))
    begun = open_
    found: list[DataFrame] = []
    while True:
        small = open_.where(F.col("_left") <= most)
        if small.limit(1).count():
            places = small.groupBy("_g", "_low", "_high", "_below").agg(F.sort_array(F.collect_set("_rank")).alias("_ranks"))
            held = _near(rows, places, ["_low", "_high", "_below", "_ranks"]).where(_INSIDE)
            held = held.groupBy("_g", "_low", "_high", "_below", "_ranks").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
            pick = F.transform("_ranks", lambda r: F.struct(r.alias("_rank"), F.get("_vs", (r - F.col("_below")).cast("int")).alias("_x")))
            found.append(cut(held.select("_g", F.inline(pick))))
            open_ = open_.where(F.col("_left") > most)
        if not open_.limit(1).count():
            break
        places = open_.select("_g", "_low", "_high").distinct()
        sketch = _near(rows, places, ["_low", "_high"]).where(_INSIDE).groupBy("_g", "_low", "_high").agg(F.percentile_approx("_v", [k / CUTS for k in range(CUTS + 1)], ACCURACY).alias("_cuts"))
        s = sketch.select(F.col("_g").alias("_of"), F.col("_low").alias("_l"), F.col("_high").alias("_h"), "_cuts")
        o = open_.join(s, (F.col("_g") == F.col("_of")) & F.col("_low").eqNullSafe(F.col("_l")) & F.col("_high").eqNullSafe(F.col("_h")))
        at = (F.col("_rank") - F.col("_below")) / F.col("_left") * CUTS
        low, high = F.get("_cuts", F.greatest(F.floor(at) - 1, F.lit(0)).cast("int")), F.get("_cuts", F.least(F.ceil(at) + 1, F.lit(CUTS)).cast("int"))
        o = cut(o.select("_g", "_rank", "_low", "_high", "_below", "_left", low.alias("_a"), high.alias("_b")))
        tests = {"_lt_a": "_v < _a", "_le_a": "_v <= _a", "_lt_b": "_v < _b", "_le_b": "_v <= _b"}
        counts = _near(rows, o, ["_rank", "_low", "_high", "_below", "_left", "_a", "_b"]).where(_INSIDE).groupBy("_g", "_rank", "_low", "_high", "_below", "_left", "_a", "_b")
        c = cut(counts.agg(*((F.count_if(F.expr(t)) + F.col("_below")).alias(n) for n, t in tests.items())))
        r = F.col("_rank")
        hit = F.when((r >= F.col("_lt_a")) & (r < F.col("_le_a")), F.col("_a")).when((r >= F.col("_lt_b")) & (r < F.col("_le_b")), F.col("_b"))
        found.append(c.select("_g", "_rank", hit.alias("_x")).where("_x IS NOT NULL"))
        under, over = r < F.col("_lt_a"), r >= F.col("_le_b")
        nexts = {
            "_low": F.when(under, F.col("_low")).when(over, F.col("_b")).otherwise(F.col("_a")),
            "_high": F.when(under, F.col("_a")).when(over, F.col("_high")).otherwise(F.col("_b")),
            "_left": F.when(under, F.col("_lt_a") - F.col("_below")).when(over, F.col("_below") + F.col("_left") - F.col("_le_b")).otherwise(F.col("_lt_b") - F.col("_le_a")),
            "_below": F.when(under, F.col("_below")).when(over, F.col("_le_b")).otherwise(F.col("_le_a")),
        }
        before, open_ = begun, cut(c.where(hit.isNull()).select("_g", "_rank", *(v.alias(k) for k, v in nexts.items())))
        free(before, o)
        begun = open_
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def percentiles(df: DataFrame, value: str | Column, probs: dict[str, float], by: tuple[str, ...] = (), count: str = "n", most: int = MOST, approximate: int | None = None, written: bool = False) -> DataFrame:
    """(by…, a column for each of probs, count): percentiles between neighbouring values by distance, as F.percentile gives them, and how many values there are.

    Groups of up to `most` rows are sorted each by a task; of larger ones no task holds more, whatever their values and ties (order_statistics). approximate: an accuracy, for values of the table near the
    percentiles instead, by mergeable sketches in one pass over df and nothing written.

    Null values don't count: a group of nulls alone has null percentiles and the count 0. NaN is above all other values, minus zero is zero. Null keys are a group. Without keys an empty table gives one row.
    df is computed once, to the shared folder; written: it has been already.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    if approximate:
        a = df.select(*by, v.alias("_v")).groupBy(*by).agg(F.percentile_approx("_v", list(probs.values()), approximate).alias("_p"), F.count("_v").alias(count))
        return a.select(*by, *(F.get("_p", k).alias(c) for k, c in enumerate(probs)), count)
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("_g"), v.alias("_v"))
    rows = rows if written else cut(rows)
    sizes = rows.groupBy("_g").agg(F.count("_v").alias("_n"))
    names = [F.col("_g")[c].alias(c) for c in by]
    large = cut(sizes.where(F.col("_n") > most))
    if not large.limit(1).count():
        out = _plain(rows, probs) if by else rows.agg(*(F.percentile("_v", p).alias(c) for c, p in probs.items()), F.count("_v").alias("_n"))
        return out.select(*names, *probs, F.col("_n").alias(count))
    few = large.count() <= FEW
    side = (F.broadcast(large) if few else large).select(F.col("_g").alias("_of"))
    same = F.col("_g") == F.col("_of")
    out = _plain(rows.join(side, same, "left_anti"), probs)
    # the ranks on both sides of each percentile
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in probs.values()))))
    ranks = large.select("_g", "_n", F.explode(wanted).alias("_rank"))
    x = order_statistics(rows.where("_v IS NOT NULL").join(side, same, "left_semi"), ranks, most)
    x = x.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_xs")).join(large.select(F.col("_g").alias("_of"), "_n"), same)

    def between(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        a, b = F.element_at("_xs", low), F.element_at("_xs", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    done = x.select("_g", *(between(p).alias(c) for c, p in probs.items()), "_n")
    return out.unionByName(done).select(*names, *probs, F.col("_n").alias(count))


def met_percentile(groups: DataFrame, met: DataFrame, meet: Callable[[DataFrame], DataFrame], key: str, p: float, low: float, high: float) -> DataFrame:
    """(key, x, n): the percentile p, as F.percentile gives it, of the values that a join gives each group, where these are too many to be written or exchanged, and how many they are. Groups without values have no row.

    met: the join's rows (key, value, times): a value from low to high, and how often it counts; meet: the same join for some of groups, whose rows have further columns that it must keep. Rows are counted where the join makes them:
    all that is exchanged is a slice's counts and ends (counted_percentile). A slice with few rows is taken value by value, so two rounds do where a group has a few thousand rows. A round needs the join again.
    """

    def counted(left: DataFrame | None) -> DataFrame:
        if left is None:
            rows = met.select(key, "value", "times", F.lit(low).alias("_low"), F.lit(high).alias("_high"), F.lit(False).alias("_last"))
        else:
            rows = meet(groups.join(left, key)).where(F.col("value").between(F.col("_low"), F.col("_high")))
        part = F.floor((F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low")) * SLICES)
        at = F.when(F.col("_last"), F.col("value")).otherwise(F.least(part, F.lit(SLICES - 1)).cast("double"))
        return rows.groupBy(key, at.alias("_at")).agg(F.sum("times").alias("_n"), F.count("*").alias("_rows"), F.min("value").alias("_least"), F.max("value").alias("_most"))

    return counted_percentile(counted, key, p)


def counted_percentile(counted: Callable[[DataFrame | None], DataFrame], key: str, p: float) -> DataFrame:
    """(key, x, n): the percentile p, as F.percentile gives it, of groups' values, and how many there are, by counts alone.

    counted: (key, _at, _n, _rows, _least, _most): for each slice of a group's values, by its place in their order, the number of values and of rows, and the least and the greatest value; of all groups if it is given none,
    else of those of a table (key, _low, _high, _last): of their values from _low to _high, in SLICES slices of the same width or, if _last, value by value. The counts tell which slice holds the ranks on both
    sides of the percentile. If these are its ends they are known, else a round goes on within it.
    """
    left = state = None
    found: list[DataFrame] = []
    while True:
        c = counted(left)
        c = c.withColumns({"_below": F.lit(0).cast("long"), "_all": F.sum("_n").over(W.partitionBy(key))}) if state is None else c.join(state, key)
        c = c.withColumn("_end", F.col("_below") + F.sum("_n").over(W.partitionBy(key).orderBy("_at"))).withColumn("_begin", F.col("_end") - F.col("_n"))
        place = (F.col("_all") - 1) * F.lit(float(p))

        def ranked(rank: Column) -> Column:
            """The value of a rank that is an end of its slice; null on other rows."""
            return F.max(F.when(rank == F.col("_begin"), F.col("_least")).when((rank == F.col("_end") - 1) | ((rank > F.col("_begin")) & (rank < F.col("_end")) & (F.col("_least") == F.col("_most"))), F.col("_most")))

        inside = (F.floor(place) >= F.col("_begin")) & (F.floor(place) < F.col("_end"))
        g = cut(c.groupBy(key, "_all").agg(ranked(F.floor(place)).alias("_a"), ranked(F.ceil(place)).alias("_b"), F.max(F.when(inside, F.struct("_least", "_most", "_begin", "_rows"))).alias("_in")))
        a, b = F.col("_a"), F.col("_b")
        x = F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b)
        found.append(g.where(a.isNotNull() & b.isNotNull()).select(key, x.alias("x"), F.col("_all").alias("n")))
        open_ = g.where(a.isNull() | b.isNull())
        if not open_.limit(1).count():
            break
        state = open_.select(key, F.col("_in._begin").alias("_below"), "_all")
        left = open_.select(key, F.col("_in._least").alias("_low"), F.col("_in._most").alias("_high"), (F.col("_in._rows") <= LAST).alias("_last"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
