"""What the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, shared_dir  # noqa: F401  what operators take from here

#: A word, as a Java and Python pattern; everything between words is ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which Hadoop's file system removes when the application ends: what a query leaves there is read as long as its result is."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: the variable of a lambda is evaluated a single time for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rekeyed(key: Column) -> Column:
    """The same whole number, but a key that Spark doesn't take for the one it has grouped by. A join on it exchanges both sides, and adaptive execution can only split the skewed partitions of a join whose sides were both exchanged for it."""
    return key.bitwiseXOR(F.lit(0).cast("long"))


def flushed(rows: Iterator[tuple], schema: pa.Schema, sizes: Callable[[tuple], int], most_bytes: int = 8 << 20, most_rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, of bounded size whatever the size of a row."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += sizes(row)
        if total >= most_bytes or len(held) >= most_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


class Remembered(dict):
    """What make gives for words. Those of two generations are kept, `most` words in all; very long words are not."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, word):
        found = self.before.get(word)
        if found is None:
            found = self.make(word)
        if len(word) < 100:
            if len(self) >= self.most // 2:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found
