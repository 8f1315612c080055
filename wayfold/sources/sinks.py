"""What stages leave: tables by bucket of frames, JSON for other tools, text reports, pictures drawn in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(rows: DataFrame, path: str, frames_per_bucket: int = 10_000) -> None:
    """Parquet in folders by range of frames, a file or so each; never a file per frame."""
    bucket = F.expr(f"frame_id div {frames_per_bucket}")
    rows.withColumn("frame_bucket", bucket).repartition("frame_bucket").write.mode("overwrite").partitionBy("frame_bucket").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def nested_matches(ranked: DataFrame, most: int) -> DataFrame:
    """(frame_id, best_match, all_candidates): a frame's candidates up to a rank in one record, as tools that read JSON expect."""
    c = F.struct(*(F.col(x) for x in ranked.columns if x != "frame_id"))
    g = ranked.where(F.col("rank") <= most).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("rank", c.alias("c")))).alias("a"))
    return g.select("frame_id", F.get("a", 0).c.alias("best_match"), F.transform("a", lambda x: x.c).alias("all_candidates"))


def nested(head: DataFrame, most: int = 100_000, **lists: DataFrame) -> DataFrame:
    """The one row of head with each of these tables as an array of its rows, in the order of its first column: a record for tools that read one JSON document. A table of more than `most` rows is refused: it is to be written as lines (write_json)."""
    out = head
    for name, rows in lists.items():
        if rows.limit(most + 1).count() > most:
            raise ValueError(f"{name} has more than {most} rows: write them as lines")
        each = F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name)
        out = out.join(F.broadcast(rows.agg(each)))  # one row each
    return out


def write_report(lines: DataFrame, path: str, title: str) -> None:
    """lines (rank, line) as text, in order, in one file: a report for people, of selected rows only."""
    head = lines.sparkSession.createDataFrame([(0, title)], "rank int, line string")
    head.unionByName(lines).orderBy("rank").coalesce(1).select("line").write.mode("overwrite").text(path)


def draw(rows: DataFrame, render: Callable[[pd.Series], bytes], key: str = "frame_id") -> DataFrame:
    """(key, picture) made by a user's function from each row, one after the other, in tasks; save it with write.parquet or a binary sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "picture": [render(r) for _, r in b.iterrows()]})

    return rows.mapInPandas(run, f"{key} long, picture binary")
