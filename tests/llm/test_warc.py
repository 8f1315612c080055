import base64
import gzip
import hashlib
import io
import os
import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wayfold.llm import warc as R


def rows():
    rng = random.Random(6)
    big = "".join(rng.choice("abcé<>\r\n") for _ in range(200_000))
    out = [(1, "http://x/ a\r\nb", None), (2, None, ""), (3, "u", "tiny"), (4, "u", "tiny"), (None, "n", "q" * 2000), (None, "n", "z" * 1500), (7, "u", "q" * 2000), (7, "u", "q" * 2000), (6, "u", "q" * 2000)]
    out += [(8, "u", "é" * 499), (9, "u", "é" * 499), (10, "u", "é" * 500), (11, "u", "é" * 500), (12, "big", big), (13, "big", big + "x"), (-5, "big", big), (14, "u", "WARC/1.1\r\n\r\n" * 100)]
    return out


def expected(data):
    last = {}
    for i, _, h in data:
        if len((h or "").encode()) >= 1000:
            last.setdefault(h, []).append(i)
    best = {h: max((i for i in v if i is not None), default=None) for h, v in last.items()}
    for i, _, h in data:
        b = (h or "").encode()
        again = h in best and best[h] is not None and i != best[h]
        yield i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[h] if again else None, b"" if again else b


@pytest.mark.parametrize("chunk", [1000, 1 << 18])
def test_round_trip(spark, tmp_path, chunk):
    data = rows()
    pages = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, payload string").repartition(3)
    R.write_archives(R.records(pages), f"{tmp_path}/a", fileBytes=50_000, chunkBytes=777)
    got = {}
    for r in R.read_archives(spark, f"{tmp_path}/a", chunk).collect():
        got.setdefault((r.record_id, r.payload_digest, r.record_type), []).append(r)
    seen = []
    for (record_id, _, kind), parts in got.items():
        parts.sort(key=lambda r: r.chunk_no)
        copies = sum(r.is_last for r in parts)
        for k in range(copies):  # equal rows have equal chunks
            own = parts[k::copies]
            assert [r.chunk_no for r in own] == list(range(len(own))) and own[-1].is_last
            whole, sha = b"", hashlib.sha1()
            for r in own:
                whole += bytes(r.data)
                sha.update(bytes(r.data))
                assert len(r.data) <= chunk and (r.bytes_so_far, r.digest_so_far) == (len(whole), sha.hexdigest())
            r = own[-1]
            page = lambda x: int(x[9:]) if x and x[9:] else None
            seen.append((page(record_id), r.payload_bytes, r.payload_digest, kind, page(r.refers_to), whole))
    assert sorted(seen, key=repr) == sorted(expected(data), key=repr)
    R.write_archives(R.records(pages.limit(0)), f"{tmp_path}/none")
    assert R.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_writes_add_up_and_attempts_count_once(spark, tmp_path):
    pages = lambda ids: spark.createDataFrame([(i, "u", f"page {i}") for i in ids], "page_id long, url string, html string").repartition(2)
    read = lambda: sorted(int(r.record_id[9:]) for r in R.read_archives(spark, f"{tmp_path}/a").collect())
    R.write_archives(R.records(pages([1, 2])), f"{tmp_path}/a")
    R.write_archives(R.records(pages([3])), f"{tmp_path}/a")
    assert read() == [1, 2, 3]
    stray = next(x for x in (tmp_path / "a").iterdir() if x.name.endswith(".warc.gz"))
    (tmp_path / "a" / "000000-attempt.warc.gz").write_bytes(stray.read_bytes())  # what a failed attempt leaves
    (tmp_path / "a" / "_MANIFEST-x.json.part").write_text("[")
    assert read() == [1, 2, 3]
    spark.dataSource.register(R.WarcDataSource)
    R.records(pages([9])).write.format("wayfold_warc").mode("overwrite").save(f"{tmp_path}/a")
    assert read() == [9]


def test_a_failed_task_that_runs_again(tmp_path):
    """In a session of its own, as retries need one that allows them."""
    code = f'''
import os
from pyspark.sql import SparkSession, functions as F
from wayfold.llm import warc as R
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
@F.udf("string")
def once(x):
    mark = "{tmp_path}/failed"
    if x == "page 7" and not os.path.exists(mark):
        open(mark, "w").close()
        raise ValueError("the first attempt")
    return x
pages = spark.range(20).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html"))
recs = R.records(pages)
R.write_archives(recs.withColumn("payload", once(F.col("payload").cast("string")).cast("binary")), "{tmp_path}/a")
got = sorted(int(r.record_id[9:]) for r in R.read_archives(spark, "{tmp_path}/a").collect())
assert got == list(range(20)) and os.path.exists("{tmp_path}/failed"), got
'''
    root = str(Path(__file__).resolve().parents[2])
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}, cwd=root)


def record(payload, plain=False, digest=None, cut=0):
    head, http = R.header("response", "urn:page:1", "http://a", digest or hashlib.sha1(payload).hexdigest(), len(payload), None, "2020-01-01T00:00:00Z")
    data = head + http + payload + b"\r\n\r\n"
    data = data[: len(data) - cut]
    return data if plain else gzip.compress(data)


def test_files_of_others():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for plain in (True, False):
        first = info if plain else gzip.compress(info)
        got = list(R.chunks(io.BytesIO(first + record(b"abc" * 100, plain) + record(b"", plain)), 128))
        assert [(r[0], r[1], r[3], r[5]) for r in got] == [("urn:i", 0, 5, True), ("urn:page:1", 0, 128, False), ("urn:page:1", 1, 256, False), ("urn:page:1", 2, 300, True), ("urn:page:1", 0, 0, True)]
        assert b"".join(r[2] for r in got[1:4]) == b"abc" * 100
    assert list(R.chunks(io.BytesIO(b""), 10)) == []
    for bad in (record(b"abc", digest="00" * 20), record(b"abc", cut=5), record(b"abc", cut=2), record(b"abc", True, cut=100)):
        with pytest.raises(ValueError):
            list(R.chunks(io.BytesIO(bad), 10))


def test_memory_of_a_long_record():
    data = io.BytesIO(record(b"0123456789abcdef" * (4 << 20)))
    tracemalloc.start()
    assert sum(len(r[2]) for r in R.chunks(data, 1 << 16)) == 64 << 20
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20


def test_header_digest():
    head, _ = R.header("revisit", "urn:page:1", None, "ab" * 20, 9, "urn:page:2", "d")
    assert base64.b32encode(bytes.fromhex("ab" * 20)) in head and b"Target" not in head and b"Refers-To: <urn:page:2>" in head


def other(kind, block, **fields):
    """A record as others write it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>", **{k.replace("_", "-"): v for k, v in fields.items() if v is not None}, "Content-Length": str(len(block))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def b32(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


HTTP = "application/http; msgtype=response"


def crawl():
    """Records of a real crawl's kinds, and (record_type, payload, payload_bytes) of each."""
    body = b"<p>" + b"flood " * 300 + b"</p>"
    parts = b"".join(b"%x;x=1\r\n%s\r\n" % (len(body[k : k + 500]), body[k : k + 500]) for k in range(0, len(body), 500)) + b"0\r\nTrailer: x\r\n\r\n"
    out = [
        (other("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"), b"software: x\r\n", 13),
        (other("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://a/"), b"", 0),
        (other("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + parts, Content_Type=HTTP, WARC_Payload_Digest=b32(body)), body, None),
        (other("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + parts, Content_Type=HTTP, WARC_Payload_Digest=b32(parts)), body, None),
        (other("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body, Content_Type=HTTP, WARC_Payload_Digest=b32(body)), body, len(body)),
        (other("response", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body, Content_Type=HTTP, WARC_Payload_Digest="sha1:" + hashlib.sha1(body).hexdigest()), body, len(body)),
        (other("response", b"HTTP/1.0 200 OK\nServer: x\n\n" + body, Content_Type=HTTP), body, len(body)),
        (other("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9999\r\n\r\n" + body[:100], Content_Type=HTTP, WARC_Payload_Digest=b32(body), WARC_Truncated="length"), body[:100], 100),
        (other("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", Content_Type=HTTP, WARC_Refers_To="<urn:page:5>", WARC_Payload_Digest=b32(body)), b"", 77),
        (other("revisit", b"", Content_Type=HTTP, WARC_Payload_Digest=b32(body)), b"", None),
        (other("metadata", b"fetchTimeMs: 7\r\n", Content_Type="application/warc-fields", WARC_Payload_Digest="md5:abc"), b"fetchTimeMs: 7\r\n", 16),
        (other("resource", b"\x00\r\n\r\n\x01", Content_Type="image/png"), b"\x00\r\n\r\n\x01", 6),
        (other("response", b"no header at all", Content_Type=HTTP), b"no header at all", 16),
    ]
    return [(r, r.split(b"WARC-Type: ")[1].split(b"\r\n")[0].decode(), payload, size) for r, payload, size in out]


@pytest.mark.parametrize("chunk", [7, 500, 1 << 18])
def test_records_of_a_crawl(chunk):
    for plain in (True, False):
        data = b"".join(r if plain else gzip.compress(r) for r, *_ in crawl())
        got, held = [], b""
        for r in R.chunks(io.BytesIO(data), chunk):
            assert len(r[2]) <= chunk and (r[1] == 0) == (held == b"")
            held += r[2]
            assert r[3] == len(held) and r[4] == hashlib.sha1(held).hexdigest()
            if r[5]:
                got.append((r[6], held, r[10]))
                held = b""
        assert got == [x[1:] for x in crawl()]
    for bad in (other("response", b"HTTP/1.1 200 OK\r\n\r\nabc", Content_Type=HTTP, WARC_Payload_Digest=b32(b"abd")), b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", other("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\nzz\r\n", Content_Type=HTTP)):
        with pytest.raises(ValueError):
            list(R.chunks(io.BytesIO(bad), 10))


def test_folders_of_others(spark, tmp_path):
    (tmp_path / "crawl" / "deep").mkdir(parents=True)
    (tmp_path / "crawl" / "deep" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r, *_ in crawl()))
    (tmp_path / "crawl" / "b.warc").write_bytes(crawl()[8][0])
    (tmp_path / "crawl" / "notes.txt").write_text("x")
    got = R.read_archives(spark, f"{tmp_path}/crawl").where("is_last").collect()
    assert len(got) == len(crawl()) + 1
    ours = sorted((r.refers_to or "", r.payload_digest) for r in got if r.record_type == "revisit")
    assert ours[1:] == [("urn:page:5", hashlib.sha1(crawl()[2][2]).hexdigest())] * 2
    assert R.read_archives(spark, f"{tmp_path}/crawl/b.warc").count() == 1
    # ours beside them: a manifest tells what counts, unless all are asked for
    R.write_archives(R.records(spark.createDataFrame([(5, "u", crawl()[2][2].decode())], "page_id long, url string, html string")), f"{tmp_path}/crawl")
    assert [r.record_id for r in R.read_archives(spark, f"{tmp_path}/crawl").where("is_last").collect()] == ["urn:page:5"]
    everything = spark.read.format("wayfold_warc").option("allFiles", "true").load(f"{tmp_path}/crawl").where("is_last")
    assert everything.count() == len(crawl()) + 2
    revisits = everything.where("record_type = 'revisit'").alias("a").join(everything.where("record_type = 'response'").alias("b"), F.expr("a.refers_to = b.record_id"))
    assert {r[0] for r in revisits.select("b.digest_so_far").collect()} == {hashlib.sha1(crawl()[2][2]).hexdigest()}
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no archive"):
        R.read_archives(spark, f"{tmp_path}/empty").count()
