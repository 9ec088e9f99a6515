"""Approximate nearest neighbours for maximum inner product by score-aware quantisation.

Codebooks. A product quantiser of SUBSPACE-dimensional parts with 16 centres each, so a part's code
takes four bits. It is fitted on a bounded sample by anisotropic k-means: of a vector's residual, the
part parallel to the vector counts ETA times as much as the part orthogonal to it, since the parallel
one is what moves large inner products. Assignment starts from the nearest centres and improves one
part at a time under that loss; each centre is then the minimiser of its members' losses, a small
linear system.

Search. Every vector is coded; codes of two parts share a byte. Queries go in blocks of QUERY_BLOCK:
a block's tables hold its partial products for each byte value, and a scan adds table rows by the
codes. Each scan keeps SHORTLIST different vectors a query, and what is within MARGIN of them, and
reranks them by exact double-precision inner products on the original vectors. A task hands on its best k, and the best of
all tasks remain.

The query set is stated by the caller and every vector is scanned for it, block by block, so there
is no pair join: work is queries times vectors, as in brute force, but at a few table rows a pair.
What is broadcast is one block of queries and the codebooks, whatever the tables hold.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite
components take no part, as queries or candidates; so do rows with a null id. Repeated rows with one
id count once. Equal scores go to the smaller id. A query never finds its own id. Extra columns are
not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.shared import materialize

CENTRES = 16
SUBSPACE = 2
ETA = 4.0
#: The codebooks are fitted on about so many vectors, chosen by hash; every vector is coded.
SAMPLE = 20_000
SHORTLIST = 150
#: The shortlist also has all vectors whose approximate scores are so close below it, as a share of the
#: longest vector's and the query's lengths: codes cannot tell the members of a tight group apart.
MARGIN = 0.01
#: Queries in a block, which one job broadcasts (8 bytes a component), and vectors in a scan.
QUERY_BLOCK = 8192
SCAN = 16_384
ROUNDS = 8

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def clean(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vector of the rows that take part; one row for each id."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.limit(0)
    return rows.where(F.size("v") == sizes[0]["d"]).dropDuplicates(["id"])


def fit(sample: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres by part: an array (parts, CENTRES, SUBSPACE)."""
    n, d = sample.shape
    parts = d // SUBSPACE
    rng = np.random.default_rng(seed)
    x = sample.reshape(n, parts, SUBSPACE)
    centres = np.stack([x[rng.choice(n, CENTRES, replace=n < CENTRES), p] for p in range(parts)])
    unit = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).reshape(n, parts, SUBSPACE)
    for _ in range(rounds):
        codes = assign(sample, centres)
        chosen = centres[np.arange(parts), codes]
        residual = x - chosen
        along = (residual * unit).sum(axis=(1, 2))
        for p in range(parts):
            u, c = unit[:, p], codes[:, p]
            # What is parallel apart from this part's own share is fixed while its centres move.
            fixed = along - ((x[:, p] - chosen[:, p]) * u).sum(axis=1)
            for k in range(CENTRES):
                own = c == k
                if not own.any():
                    centres[p, k] = x[rng.integers(n), p]
                    continue
                uu = np.einsum("ni,nj->ij", u[own], u[own])
                left = own.sum() * np.eye(SUBSPACE) + (ETA - 1) * uu
                right = x[own, p].sum(axis=0) + (ETA - 1) * (u[own] * ((x[own, p] * u[own]).sum(axis=1) + fixed[own])[:, None]).sum(axis=0)
                centres[p, k] = np.linalg.solve(left, right)
            new = centres[p, c]
            along = fixed + ((x[:, p] - new) * u).sum(axis=1)
            chosen[:, p] = new
    return centres


def assign(vectors: np.ndarray, centres: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (n, parts) under the anisotropic loss |r|^2 + (ETA - 1) * (r . x / |x|)^2."""
    n, d = vectors.shape
    parts = len(centres)
    x = vectors.reshape(n, parts, SUBSPACE)
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).reshape(n, parts, SUBSPACE)
    codes = np.empty((n, parts), np.int64)
    square, along = [], []
    for p in range(parts):
        r = x[:, p, None] - centres[None, p]
        square.append((r * r).sum(axis=2))
        along.append((r * unit[:, p, None]).sum(axis=2))
        codes[:, p] = square[p].argmin(axis=1)
    rows = np.arange(n)
    total = sum(along[p][rows, codes[:, p]] for p in range(parts))
    for _ in range(sweeps):
        for p in range(parts):
            rest = total - along[p][rows, codes[:, p]]
            codes[:, p] = (square[p] + (ETA - 1) * (rest[:, None] + along[p]) ** 2).argmin(axis=1)
            total = rest + along[p][rows, codes[:, p]]
    return codes


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, (bytes, n)."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), codes.dtype)])
    return np.ascontiguousarray((codes[:, ::2] * 16 + codes[:, 1::2]).astype(np.uint8).T)


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Partial products by byte value: (bytes, 256, queries)."""
    parts = len(centres)
    products = np.einsum("qpi,pki->pkq", queries.reshape(len(queries), parts, SUBSPACE), centres)
    if parts % 2:
        products = np.concatenate([products, np.zeros_like(products[:1])])
    both = products[::2, :, None, :] + products[1::2, None, :, :]
    return np.ascontiguousarray(both.reshape(len(both), 256, -1).astype(np.float32))


def scan(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Approximate products of all coded vectors with a block of queries: (n, queries)."""
    out = table[0][codes[0]]
    for part, rows in zip(table[1:], codes[1:], strict=True):
        out += part[rows]
    return out


def distinct(vectors: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal vectors as one: each kept id's vector number, each vector's first row, and the kept ids.

    Ids are ascending. Of equal vectors only the ``most`` smallest ids are kept: equal scores go to
    smaller ids, so no search for fewer could return another.
    """
    rows = np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()
    _, first, own = np.unique(rows, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")  # vectors by their smallest id
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    own = place[own.ravel()]
    by = np.argsort(own, kind="stable")
    own = own[by]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return own[rank < most], first[order], ids[by][rank < most]


def shortlist(scores: np.ndarray, many: int, margin: np.ndarray) -> list[np.ndarray]:
    """Row numbers, for each column, of the ``many`` best scores and all within ``margin`` below them."""
    n = len(scores)
    columns = np.ascontiguousarray(scores.T)
    if n <= many:
        return [np.arange(n)] * len(columns)
    cut = np.partition(columns, n - many, axis=1)[:, n - many] - margin
    return [np.flatnonzero(column >= low) for column, low in zip(columns, cut, strict=True)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, many: int = SHORTLIST) -> DataFrame:
    """query_id, vec_id, score: each query's best ``k``, before ranks. Both frames come from :func:`clean`."""
    spark = vectors.sparkSession
    total = max(1, vectors.count())
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(total)) < SAMPLE).select("v").toPandas()["v"]
    if not len(sample):
        sample = vectors.limit(1).select("v").toPandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], FOUND)
    sample = np.stack(sample.to_list())
    d = sample.shape[1]
    width = -(-d // SUBSPACE) * SUBSPACE
    pad = lambda x: np.pad(x, ((0, 0), (0, width - d)))
    centres = fit(pad(sample))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scans of up to SCAN vectors: ids, codes and original vectors as packed bytes."""
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN):
                part = batch.slice(at, SCAN)
                ids = part.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)[order]
                own, first, ids = distinct(v, ids[order], k + 1)
                codes = packed(assign(pad(v[first]), centres))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), own.astype("<i8"), codes, v[first])], names=["ids", "own", "codes", "vectors"])

    scans = materialize(vectors.select("id", "v").mapInArrow(code, "ids binary, own binary, codes binary, vectors binary"), "scans", "none")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).alias("block"))
    found = None
    for block in range(blocks):  # a job for each block; a block's queries are all the driver holds
        rows = numbered.where(F.col("block") == block).toPandas()
        if not len(rows):
            continue
        q_ids, q = rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_list())
        part = scans.mapInArrow(_scanner(spark.sparkContext.broadcast((centres, q_ids, q)), d, pad, k, many), FOUND)
        if blocks > 1:
            part = materialize(best(part, k), "nearest")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], FOUND)


def _scanner(shared, d: int, pad, k: int, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, q_ids, q = shared.value
        top_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        top_scores = np.full((len(q), k), -np.inf)
        for batch in batches:
            for row in batch.to_pylist():
                ids, own = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["own"], "<i8")
                v = np.frombuffer(row["vectors"], np.float64).reshape(-1, d)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(v))
                starts = np.searchsorted(own, np.arange(len(v) + 1))
                longest = np.linalg.norm(v, axis=1).max()
                v = v[own]
                for at in range(0, len(q), 64):
                    block = q[at : at + 64]
                    near = shortlist(scan(codes, tables(pad(block), centres)), many, MARGIN * longest * np.linalg.norm(block, axis=1))
                    for j, rows in enumerate(near):
                        rows = starts[rows] if len(ids) == codes.shape[1] else np.concatenate([np.arange(starts[x], starts[x + 1]) for x in rows])
                        rows = rows[ids[rows] != q_ids[at + j]]
                        all_ids = np.concatenate([top_ids[at + j], ids[rows]])
                        all_scores = np.concatenate([top_scores[at + j], (v[rows] * q[at + j]).sum(axis=1)])
                        first = np.lexsort((all_ids, -all_scores))[:k]
                        top_ids[at + j], top_scores[at + j] = all_ids[first], all_scores[first]
        full = np.isfinite(top_scores)
        which = np.repeat(q_ids[:, None], k, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(which[full]), pa.array(top_ids[full]), pa.array(top_scores[full])], names=["query_id", "vec_id", "score"])

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    return ranked(found, k).select("query_id", "vec_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's best ``k`` with ranks from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` for the queries whose vec_id is divisible by 20."""
    vectors = materialize(clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return ranked(search(vectors, vectors.where("id % 20 = 0"), 20), 20)
