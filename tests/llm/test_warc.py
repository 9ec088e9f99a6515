import hashlib
import base64

import pytest

from millrace.llm import warc as W
from millrace.plans.shared import new_path

S = "page_id long, url string, html string, payload_bytes int, refers_to string, sha1 string"


def check(spark, rows, segment=W.SEGMENT_BYTES, least=0, per_file=None):
    df = spark.createDataFrame(rows, S).repartition(3)
    path = new_path(spark, "test-warc")
    W.write_archives(W.classify(df, least), path, segment)
    got = W.read_archives(spark, path).collect()
    rows = [r for r in rows if r[0] is not None]
    keeper = {}
    for r in rows:
        keeper[r[2] or ""] = max(keeper.get(r[2] or "", r[0]), r[0])
    want = []
    for r in rows:
        raw = (r[2] or "").encode()
        to = keeper[r[2] or ""]
        revisit = to != r[0] and len(raw) >= least
        want.append((r[0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None, None if revisit else raw))
    show = lambda xs: sorted(xs, key=str)
    assert show(want) == show((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in got)
    return path


def rows_of(texts):
    return [(i, f"http://h/{i} é", t, 1, "x", "y") for i, t in enumerate(texts)]


def test_round_trip_with_segments(spark, monkeypatch):
    texts = [None, "", "é" * 5000, "x\r\n\r\nWARC/1.1\r\n" * 400, "x\r\n\r\nWARC/1.1\r\n" * 400, "short", "short", "short", "\r\n", "z" * 100_000]
    rows = rows_of(texts) + [(None, "u", "lost", 1, "x", "y"), (5, "again", "short", 1, "x", "y")]
    check(spark, rows)
    check(spark, rows, segment=700)
    check(spark, rows, segment=700, least=6)
    monkeypatch.setattr(W, "RECORDS_PER_FILE", 2)  # segments of one record in several files
    check(spark, rows, segment=700)


def test_query_tables(spark, sf_dir):
    raw = [(r["page_id"], r["url"], r["html"], 1, "x", "y") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    check(spark, raw, segment=2000)


def test_empty(spark):
    assert W.read_archives(spark, check(spark, [])).count() == 0


def test_faults_are_found():
    with pytest.raises(ValueError):
        W.join_segments([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(ValueError):
        W.join_segments([(1, None, b"a"), (2, 3, b"b")])
    with pytest.raises(ValueError):
        W.unchunk(b"H\r\n\r\n3\r\nabcd\r\n0\r\n\r\n")
    assert W.unchunk(b"H\r\n\r\n3;x=1\r\nabc\r\n1\r\nd\r\n0\r\nT: 1\r\n\r\n") == b"abcd"
    with pytest.raises(ValueError):
        list(W.parse_archive(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))
