import base64
import gzip
import hashlib
import os
import re

import pytest

from runlens.llm import warc

PAGES = "page_id bigint, url string, html string"


def want(rows, least=0):
    first = {}
    for p, _, h in rows:
        first.setdefault(h or "", set()).add(p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        ids = first[h or ""]
        lead = min((i for i in ids if i is not None), default=None)
        response = p == lead or len(body) < least
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else lead))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ODD = [(3, "http://a", "x"), (1, "http://b\r\nX: 1", "x"), (2, None, None), (5, "u", ""), (4, "", "héllo\r\n\r\nWARC/1.1\r\n"), (7, "u", "x"), (7, "u", "x"), (None, "n", "x"), (None, "n", "only"), (9, "z", "long " * 50000)]


@pytest.mark.parametrize("least", [0, 3])
def test_odd_rows(spark, least):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in ODD], PAGES + ", key string, payload string")
    back = warc.read_archive(spark, warc.write_archive(df, least=least))
    assert got(back) == want(ODD, least)


def test_each_payload_is_stored_once(spark):
    path = warc.write_archive(spark.createDataFrame(ODD, PAGES))
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ODD})
    assert spark.read.parquet(f"{path}/records").count() == len(ODD)


def test_records_are_exact(spark, tmp_path):
    df = spark.createDataFrame(ODD, PAGES)
    back = warc.read_archive(spark, warc.write_archive(df))
    warc.export_warc(back.coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    found = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block, data = rest[: int(fields[b"Content-Length"])], rest[int(fields[b"Content-Length"]):]
        assert head.startswith(b"WARC/1.1\r\n") and data[:4] == b"\r\n\r\n"
        data = data[4:]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        if fields[b"WARC-Type"] == b"response":
            assert len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
        else:
            assert not payload and b"WARC-Refers-To" in fields
        found.append(digest)
    assert sorted(found) == sorted(r[2] for r in want(ODD))


def test_a_damaged_payload_is_noticed(spark):
    path = warc.write_archive(spark.createDataFrame(ODD, PAGES))
    from pyspark.sql import functions as F

    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(f"{path}/worse")
    bad.sparkSession.read.parquet(f"{path}/worse").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()


def test_empty(spark):
    assert warc.read_archive(spark, warc.write_archive(spark.createDataFrame([], PAGES))).count() == 0


def test_query(run, table):
    rows = [(r["page_id"], r["url"], r["html"]) for r in table("pages")]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run("op3_warc")), key=str) == want(rows)
