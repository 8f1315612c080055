"""Running values and neighbours along an order, by pieces: ranges of the order that hold about as many rows each, gone through by a task each, with what is carried from piece to piece taken from their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import cut

#: What pieces adds to rows.
PIECE, PLACE = "_piece", "_place"


def inside(by: str) -> W:
    """A piece's rows of a group, in order."""
    return W.partitionBy(PIECE, by).orderBy(PLACE)


def pieces(rows: DataFrame, by: str, order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """rows with _piece and _place, written: rows of a group (by) and a piece follow each other by _place, from 1, and a group's pieces by _piece.

    Pieces are ranges of (by, order), so a long group has many, and rows of the same order share one. Their number is that of shuffle partitions, or `ranges`; a piece with rows of many groups is gone through
    group by group. Nulls come first. Rows that tie in all of order follow in any way, which is then kept. rows are gone through twice; give what is dear to compute written.
    """
    keys = [F.col(c).asc_nulls_first() for c in (by, *order)]
    r = (rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)).withColumn(PIECE, F.spark_partition_id())
    return cut(r.withColumn(PLACE, F.row_number().over(W.partitionBy(PIECE, by).orderBy(*(F.col(c).asc_nulls_first() for c in order)))))


def totals(cut_: DataFrame, by: str, **columns: Column) -> DataFrame:
    """A row for each group and piece: by, _piece, _n (its rows) and these aggregates. first() and last() give values of its ends."""
    return cut_.groupBy(by, PIECE).agg(F.max(PLACE).alias("_n"), *(c.alias(n) for n, c in columns.items()))


def first(value: str) -> Column:
    return F.min_by(F.struct(F.col(value).alias("v")), PLACE).v


def last(value: str) -> Column:
    return F.max_by(F.struct(F.col(value).alias("v")), PLACE).v


def along(by: str) -> W:
    """A group's pieces, in order: of totals, of which there are as many as pieces, not rows."""
    return W.partitionBy(by).orderBy(PIECE)


def carried(cut_: DataFrame, totals_: DataFrame, by: str, *columns: str) -> DataFrame:
    """Rows with columns of their piece's totals; the totals are as many as pieces and groups."""
    t = totals_.select(F.col(by).alias("_by"), F.col(PIECE).alias("_of"), *columns)
    return cut_.join(t, cut_[by].eqNullSafe(F.col("_by")) & (F.col(PIECE) == F.col("_of")), "left").drop("_by", "_of")
