"""Vector codes by product quantisation over integers, with VA-file filtering of the nearest entry.

Vectors are cut into equal parts; each part position has a codebook of at most ENTRIES entries, which starts as that part of
the first rows by id and moves in ROUNDS rounds to its parts' floored means. A code has two hex digits a part.

Filtering. Entries' coordinates are quantised to BITS bits, which puts each entry in a cell. A query part has a
table of the least and the greatest squared distance to each cell of each coordinate; sums of table entries bound its distance to
every entry from below and above. Only entries whose lower bound is at most the least upper bound are refined,
by integer distances, so the nearest entry, and of equally near ones the lower index, is always among them.

Scale. Each round is one pass over the vectors: a task adds up its own parts for each entry, Spark adds the tasks' sums.
Codebooks have ENTRIES times as many numbers as a vector, whatever the table holds; they go to the tasks with the function.

Defined results: rows whose vector is null, holds null or non-finite components, or has another length than most
take no part. Components are clamped as :mod:`integers` says. Rows with a null id take part, after all others. Repeated rows count
each; rows with one id are in order of their vectors. Lengths that PARTS does not divide are cut at
floor(d * k / PARTS), so parts differ by one at most. With fewer rows than ENTRIES there are as many entries as rows. Null labels
are one label. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.integers import floored
from millrace.plans.shared import materialize, spread, with_facts

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Bits of a cell's number along one coordinate.
BITS = 3


def cells(book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each entry's cell along each coordinate, and the least and greatest coordinates (width, 2 ** BITS) of all cells."""
    low = book.min(axis=0)
    step = np.maximum(1, -(-(book.max(axis=0) - low + 1) // (1 << BITS)))
    first = low[:, None] + step[:, None] * np.arange(1 << BITS)
    return (book - low) // step, first, first + step[:, None] - 1


def candidates(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries (n, entries) may be nearest to the parts ``x`` (n, width), by bounds alone."""
    own, first, last = cells(book)
    below, above = first - x[:, :, None], x[:, :, None] - last
    least = np.maximum(np.maximum(below, above), 0) ** 2
    most = np.maximum(np.abs(below), np.abs(above)) ** 2
    low = np.zeros((len(x), len(book)), np.int64)
    high = np.zeros_like(low)
    for j in range(x.shape[1]):
        low += least[:, j, own[:, j]]
        high += most[:, j, own[:, j]]
    return low <= high.min(axis=1)[:, None]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, ties to the lower index, and its squared distance."""
    rows, entries = np.nonzero(candidates(x, book))
    exact = ((x[rows] - book[entries]) ** 2).sum(axis=1)
    starts = np.searchsorted(rows, np.arange(len(x)))
    least = np.minimum.reduceat(exact, starts) if len(x) else np.zeros(0, np.int64)
    hit = np.flatnonzero(exact == least[rows])
    return entries[hit[np.unique(rows[hit], return_index=True)[1]]], least


def cuts(d: int) -> list[slice]:
    return [slice(d * k // PARTS, d * (k + 1) // PARTS) for k in range(PARTS)]


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, d)


def fit(vectors: DataFrame, d: int) -> list[np.ndarray]:
    """The codebooks, (entries, width) by part, of ``vectors`` (vec_id, v)."""
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    start = np.asarray([r["v"] for r in first], np.int64).reshape(len(first), d)
    books = [start[:, c] for c in cuts(d)]
    width = max(b.shape[1] for b in books)
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((PARTS, len(books[0])), np.int64)
            sums = [np.zeros(b.shape, np.int64) for b in books]
            for batch in batches:
                v = _matrix(batch, d)
                for p, c in enumerate(cuts(d)):
                    own, _ = nearest(v[:, c], books[p])
                    counts[p] += np.bincount(own, minlength=len(books[p]))
                    np.add.at(sums[p], own, v[:, c])
            used = [(p, e) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in used], pa.int32()) for i in (0, 1)] + [pa.array([int(counts[x]) for x in used], pa.int64()), pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

        parts = vectors.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
        total = [F.sum(F.get("s", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
        moved = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()  # at most PARTS * ENTRIES rows
        books = [b.copy() for b in books]
        for r in moved:
            own = books[r["part"]]
            own[r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(own.shape[1])]
    return books


def digest(books: list[np.ndarray]) -> str:
    """Lower-case hex of all entries' numbers by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], d: int) -> DataFrame:
    """``vectors`` (vec_id, label, v) with code and error in place of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch, d)
            found = [nearest(v[:, c], book) for c, book in zip(cuts(d), books, strict=True)]
            codes = np.stack([own for own, _ in found], axis=1).astype(np.uint8)
            error = sum(far for _, far in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of ``rows`` (vec_id, label, v)."""
    key = F.to_json(F.struct(F.col("label").alias("x")))  # null is a value like any other
    kept, d = floored(spread(rows.select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("label"), "v")), SCALE)
    kept = materialize(kept, "integers")
    books = fit(kept, d)
    coded = materialize(encode(kept, books, d), "codes")
    errors = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "errors")
    return with_facts(coded, errors, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    near = f"""a{k} AS (SELECT i, p, min_by(e, dist * {ENTRIES} + e) AS e, min(dist) AS dist FROM (
        SELECT i, p, e, list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM parts JOIN b{k} USING (p)) GROUP BY i, p)"""
    if k == ROUNDS:
        return near
    return f"""{near}, m{k} AS (
        SELECT p, e, list(mean ORDER BY j) AS c FROM (SELECT p, a{k}.e, j, CAST(floor(sum(w[j]) / count(*)) AS BIGINT) AS mean FROM a{k} JOIN parts USING (i, p), range(1, 9) t(j) GROUP BY ALL) GROUP BY ALL),
    b{k + 1} AS (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""


#: For vectors of 64 components.
ORACLE_SQL = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT i, p, v[p * 8 + 1 : p * 8 + 8] AS w FROM kept, range({PARTS}) t(p)),
b0 AS (SELECT p, i - 1 AS e, w AS c FROM parts WHERE i <= {ENTRIES}),
{", ".join(_round(k) for k in range(ROUNDS + 1))},
coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (i), books
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all of ``embeddings``."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("v")))
