"""Helpers that other column functions are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is evaluated a single time for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for each row, however many filters and columns use them later: they come from a generator of one row, through which Spark moves no filter. Moved below plain columns, a filter repeats
    their expressions, and code that has grown too long for the JVM to compile is interpreted."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def iterate(start: Column, times: int, step: Callable[[Column], Column]) -> Column:
    """step applied to start so many times, without an expression that doubles at each."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda x, _: step(x))


def mod(x: Column, n: float) -> Column:
    """x modulo n with the sign of n, as Python has it."""
    return F.pmod(x, F.lit(float(n)))


def iso_text(time: Column) -> Column:
    """A timestamp as ISO 8601 text, to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def time_label(text: Column) -> Column:
    """ISO 8601 text as people read it (day, month, year, hour, minute); what isn't a time stays as it is."""
    return F.coalesce(F.date_format(text.try_cast("timestamp"), "dd MMM yyyy  HH:mm"), text)


def round_scaled(x: Column, digits: int) -> Column:
    """x times a power of ten, rounded to a whole number (ties away from zero), and divided again, all in double precision, as C programs and SQL engines written in it round; Spark's round takes the shortest text of x."""
    power = float(10**digits)
    return F.round(x * power) / power


def round_exact(x: Column, digits: int) -> Column:
    """x rounded by its exact binary value, ties to even: what Python's round(x, digits) gives for |x| * 10**digits < 2**52.

    The product with the power of ten is taken as a double plus its rounding error (Dekker), so that 2.675, which lies below
    the tie that its text shows, goes down.
    """
    power = float(10**digits)
    c = 134217729.0
    ph = c * power - (c * power - power)
    pl = power - ph

    def chosen(s: Column) -> Column:
        low = F.floor(s.p)
        over = (s.p - low.cast("double") - 0.5) + s.e
        up = (over > 0) | ((over == 0) & (low % 2 != 0))
        return (low + F.when(up, 1).otherwise(0)).cast("double") / power

    def product(s: Column) -> Column:
        p = s.x * power
        return F.struct(p.alias("p"), (((s.h * ph - p) + s.h * pl + (s.x - s.h) * ph) + (s.x - s.h) * pl).alias("e"))

    return let(let(F.struct(x.alias("x"), (x * c - (x * c - x)).alias("h")), product), chosen)
