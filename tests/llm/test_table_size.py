"""Queries against their SQL on tables of the driver's size that have what its own lack: revisits, and dialogues of several parts and pieces; and very long texts."""

import duckdb
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm import line_dedup, perspectives, token_counts, warc

SF = "/root/testdata/sf0.01"


def same(spark, at, query, sql, table):
    rows = query(spark, at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet/*.parquet')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = sorted((tuple(r[n] for n in names) for r in rows.collect()), key=repr)
    assert sorted(rows.columns) == sorted(names) and got == sorted(map(tuple, want.fetchall()), key=repr)
    return [dict(zip(names, r, strict=True)) for r in got]


def test_revisits(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = [pages]
    for k in range(1, 6):
        more.append(pages.where(F.col("page_id") % 7 < k).withColumns({"page_id": F.col("page_id") + 1000 * k * (-1) ** k, "url": F.concat(F.lit("http://mirror/"), "url")}))
    union = more[0]
    for m in more[1:]:
        union = union.unionByName(m)
    union.write.parquet(f"{tmp_path}/pages.parquet")
    got = same(spark, str(tmp_path), warc.op2_warc, warc.ORACLES["op2_warc"], "pages")
    kinds = [r["record_type"] for r in got]
    assert kinds.count("revisit") > 400 and kinds.count("response") > 200
    ids = {r["page_id"]: r for r in got}
    assert all(ids[r["refers_to"]]["record_type"] == "response" and ids[r["refers_to"]]["payload_digest"] == r["payload_digest"] for r in got if r["record_type"] == "revisit")


def test_long_dialogues(spark, tmp_path):
    """All conversations end to end in seven, in one of which many turns share a number."""
    c = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    w = W.partitionBy(F.col("conv_id") % 7).orderBy("conv_id", "turn")
    n = F.row_number().over(w)
    turn = F.when(F.col("conv_id") % 7 == 3, F.floor(n / 200)).otherwise(n).cast(c.schema["turn"].dataType)
    c.select((F.col("conv_id") % 7).alias("conv_id"), turn.alias("turn"), F.when(F.col("conv_id") % 5 == 0, F.concat("role", F.lit(" b"))).otherwise(F.col("role")).alias("role"), "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = same(spark, str(tmp_path), perspectives.op7_perspectives, perspectives.ORACLES["op7_perspectives"], "conversations")
    assert max(r["part"] for r in got) >= 5 and max(r["piece"] for r in got) >= 3 and len({r["speaker"] for r in got}) >= 3


def test_very_long_texts(spark):
    line = "a line of forty code points or even more, as it is "
    long = "\n".join(f"{line}{k % 1000}" for k in range(150_000))
    docs = spark.createDataFrame([(k, long if k == 3 else "\n".join(f"{line}{k + j}" for j in range(6))) for k in range(8)], "doc_id long, text string")
    got = {r.id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    # each key's lines stay in the largest of five documents or more that have it
    holders = {}
    for r in docs.collect():
        for x in set(r.text.split("\n")):
            holders.setdefault(x, set()).add(r.doc_id)
    keep = lambda d, x: len(holders[x]) < 5 or max(holders[x]) == d
    for r in docs.collect():
        assert got[r.doc_id] == "\n".join(x for x in r.text.split("\n") if keep(r.doc_id, x))
    counts = token_counts.token_counts(docs.where("doc_id = 3"), ([b"a", b"line", b"of"], [b"x"])).first()
    assert counts.n_words == len(long.split())
    turns = spark.createDataFrame([(1, 1, "a", long), (1, 2, "b", "short <|")], "conv_id long, turn long, role string, text string")
    seen = {r.speaker: r for r in perspectives.perspectives(turns).collect()}
    assert set(seen) == {"a", "b"} and seen["a"].spans[0].end - seen["a"].spans[0].begin == len(long) + len("<|end|>\n")
    assert long in seen["b"].text
