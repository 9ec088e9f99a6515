"""WARC archives: writing with segmentation and chunked framing, and reassembly on reading back.

Writing. Each page is an HTTP response in chunked transfer framing. Of pages with equal payloads the
one with the largest page_id is stored as ``response``, the others as ``revisit`` without payload.
A record block over ``segment_bytes`` is cut into a first segment and ``continuation`` records that
carry WARC-Segment-Origin-ID and WARC-Segment-Number; the last one has WARC-Segment-Total-Length.
The text sink writes the archives, so they go to any store Spark can write, and files are bounded by
records per file times the segment size.

Reading. Whole archive files are parsed into records. Segments are grouped by the identifier of
their origin, ordered by number, joined, and held against the stated total length; then the chunked
framing is decoded and the payload digest checked. Missing or repeated segments and wrong lengths or
digests raise an error. Records whose segments are all in one file are joined where they are read;
only the others are shuffled.

Defined results: null html counts as an empty payload. Payloads under ``least`` bytes are all
``response``. Rows with a null page_id are left out, since no record can be named for them. Repeated
rows with one page_id give one record each. Very long payloads are cut into segments; equal payloads have one
keeper, so there are no ties. Extra columns are not read. An empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.shared import materialize, new_path, with_facts

SEGMENT_BYTES = 64 * 1024
RECORDS_PER_FILE = 1000
CHUNK_BYTES = 8192
DATE = "2024-01-01T00:00:00Z"

PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def classify(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, row, url, html, digest, size and refers_to (null for responses).

    Only digests and ids meet in the grouping; the html moves once, by its own row.
    """
    rows = pages.where(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    facts = rows.select("page_id", "sha1", F.octet_length("html").cast("long").alias("size"))
    facts = materialize(facts, "digests").where(F.col("size") >= least)
    # Digests seen once need no row here: their page is its own response.
    keepers = materialize(facts.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1"), "keepers")
    # One payload, as the empty one, may be that of very many pages.
    later = with_facts(facts, keepers, "sha1").where("page_id <> keeper").select("page_id", "sha1", F.col("keeper").alias("refers_to")).distinct()
    return rows.join(later, ["page_id", "sha1"], "left")


def http_block(payload: bytes, revisit: bool) -> bytes:
    """The HTTP response: chunked framing for a response, headers alone for a revisit."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        return head
    parts = [head]
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        parts.append(b"%x\r\n%b\r\n" % (len(part), part))
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunk(framed: bytes) -> bytes:
    """The payload of an HTTP response in chunked framing; extensions and trailers are allowed."""
    at = framed.index(b"\r\n\r\n") + 4
    out = []
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than it says")
        out.append(framed[at : at + size])
        at += size + 2


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int, number: int = 1, serial: int = 0) -> str:
    return f"<urn:page:{page_id}:{serial}:{number}>"


def records_of(page_id: int, serial: int, url: str, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of a page, each without the last of its closing line feeds."""
    block = http_block(payload, refers_to is not None)
    segments = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    uri = "".join(x if " " < x < "\x7f" else "%%%02X" % (ord(x) & 255) for x in url or "urn:none")
    for number, part in enumerate(segments, 1):
        head = ["WARC/1.1", f"WARC-Type: {'continuation' if number > 1 else 'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, number, serial)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
        if number == 1:
            head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}"]
            if refers_to is not None:
                head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if len(segments) > 1:
            head.append(f"WARC-Segment-Number: {number}")
            if number > 1:
                head.append(f"WARC-Segment-Origin-ID: {record_id(page_id, 1, serial)}")
            if number == len(segments):
                head.append(f"WARC-Segment-Total-Length: {len(block)}")
        head.append(f"Content-Length: {len(part)}")
        yield "\r\n".join(head).encode() + b"\r\n\r\n" + part + b"\r\n\r"


def write_archives(classified: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the rows of :func:`classify` as gzipped archives under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[int] = Counter()
        for rows in batches:
            found = []
            for page_id, url, html, refers_to in zip(rows["page_id"], rows["url"], rows["html"], rows["refers_to"], strict=True):
                serial, seen[page_id] = seen[page_id], seen[page_id] + 1
                found += records_of(int(page_id), serial, url, html.encode(), None if pd.isna(refers_to) else int(refers_to), segment_bytes)
            yield pd.DataFrame({"value": pd.Series(found, dtype=object)})

    records = classified.select("page_id", "url", "html", F.col("refers_to").cast("string")).mapInPandas(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers by lower-case name, and the block."""
    at = 0
    while at < len(content):
        if content[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        at = end + 4 + size
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is longer or shorter than it says")
        yield head, content[end + 4 : at]
        at += 4


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a segmented record from (number, total length of the last one, bytes)."""
    parts = sorted(parts, key=lambda x: x[0])
    if [x[0] for x in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] is None:
        raise ValueError("segments are missing or repeated")
    block = b"".join(x[2] for x in parts)
    if len(block) != parts[-1][1]:
        raise ValueError("the segments' total length is wrong")
    return block


def _page_row(kind, uri, page_id, digest, size, refers_to, block: bytes, with_payload: bool) -> tuple:
    if kind == "response":
        payload = unchunk(block)
        if digest32(payload) != digest or len(payload) != size:
            raise ValueError(f"page {page_id}: its payload is not the stated one")
    return page_id, size, digest, kind, refers_to, uri, payload if with_payload and kind == "response" else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every page of the archives under ``path``; revisits have no payload of their own."""
    import gzip

    def facts(head: dict[str, str]) -> tuple:
        page_id = int(re.fullmatch(r"<urn:page:(-?\d+):.*>", head["warc-record-id"])[1])
        refers = head.get("warc-refers-to")
        return head["warc-type"], head.get("warc-target-uri"), page_id, head.get("warc-payload-digest", "").removeprefix("sha1:"), int(head.get("x-payload-length", 0)), int(re.fullmatch(r"<urn:page:(-?\d+):.*>", refers)[1]) if refers else None

    names = ["origin", "number", "total", "kind", "uri", "page_id", "digest", "size", "refers_to", "block"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                done, open_ = [], {}
                for head, block in parse_archive(gzip.decompress(content) if name.endswith(".gz") else content):
                    number = int(head.get("warc-segment-number", 0))
                    origin = head.get("warc-segment-origin-id", head["warc-record-id"])
                    total = head.get("warc-segment-total-length")
                    row = (origin, number, int(total) if total else None, *facts(head), block)
                    if not number:
                        done.append(row)
                        continue
                    parts = open_.setdefault(origin, [])
                    parts.append(row)
                    last = next((x[1] for x in parts if x[2] is not None), None)
                    if last == len(parts):
                        whole = join_segments([(x[1], x[2], x[9]) for x in open_.pop(origin)])
                        first = min(parts, key=lambda x: x[1])
                        done.append((origin, 0, None, *first[3:9], whole))
                rest = [x for parts in open_.values() for x in parts]
                ready = [_page_row(*x[3:9], x[9], with_payload) for x in done]
                columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                yield pd.DataFrame({c: pd.Series([None] * len(rest) + [r[i] for r in ready], dtype=object) for i, c in enumerate(columns)} | {f"s_{c}": pd.Series([r[i] for r in rest] + [None] * len(ready), dtype=object) for i, c in enumerate(names)})

    kinds = ["string", "int", "long", "string", "string", "long", "string", "long", "long", "binary"]
    both = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    both = materialize(both.mapInPandas(parse, PAGES + ", " + ", ".join(f"s_{n} {k}" for n, k in zip(names, kinds, strict=True))), "archive-records")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        none = lambda x: None if pd.isna(x) else int(x)
        block = join_segments([(int(n), none(t), b) for n, t, b in zip(rows["s_number"], rows["s_total"], rows["s_block"], strict=True)])
        first = rows.loc[rows["s_number"].idxmin()]
        row = _page_row(first["s_kind"], first["s_uri"], int(first["s_page_id"]), first["s_digest"], int(first["s_size"]), none(first["s_refers_to"]), block, with_payload)
        return pd.DataFrame([row], columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]).astype(object)

    apart = both.where(F.col("s_origin").isNotNull()).select([f"s_{n}" for n in names]).groupBy("s_origin").applyInPandas(join, PAGES)
    return both.where(F.col("s_origin").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload").unionByName(apart)


ORACLE_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), k AS (
    SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS keeper, sha1(html) AS hex FROM p
), d AS (
    SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(k.hex, 1 + g * 5, 5)) AS BIGINT) // CAST(pow(32, 3 - j) AS BIGINT) % 32, 1), '' ORDER BY g, j)
        FROM range(8) t(g), range(4) u(j)) AS b32 FROM k
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
    CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written to archives and read back: digests, types and what revisits refer to."""
    path = new_path(spark, "warc")
    write_archives(classify(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    pages = read_archives(spark, path, with_payload=False)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
