"""Dense vectors: checks, normalisation, exact search for stated queries, and delta embedding."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6
#: Queries that one scan carries; larger sets are searched in blocks of this many.
QUERY_BLOCK = 1024
#: Pairs that a task scores, and those that it holds.
TASK_PAIRS, BATCH_PAIRS = 50_000_000, 100_000
#: As many digits as a double can have.
WIDE = Context(prec=700)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in component order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """A unit vector; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def valid(v: Column, dimension: int) -> Column:
    """Of the right length and finite throughout."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def scores(vectors: DataFrame, queries: DataFrame, places: int = PLACES) -> DataFrame:
    """(query_id, id, score) of every vector for every stated query; none of either has a null score.

    Queries go in blocks of QUERY_BLOCK to the tasks, as matrices; a task multiplies a few rows at a time with them, so
    there is no pair join, and what it holds is bounded. ``vectors``: id, vector; ``queries``: query_id, vector.
    """
    rows = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    kind = dict(queries.dtypes)["query_id"]
    numbered = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    asked_in_all = numbered.count()
    blocks = max(1, -(-asked_in_all // QUERY_BLOCK))
    # A task's share of pairs stays the same however many there are.
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() * min(asked_in_all, QUERY_BLOCK) // TASK_PAIRS))
    rows = rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows
    schema = f"query_id {kind}, id {dict(vectors.dtypes)['id']}, score double"
    out = None
    for block in range(blocks):
        asked = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if asked:
            part = rows.mapInArrow(_all_pairs([tuple(r) for r in asked], places), schema)
            out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def _half_up(v: np.ndarray, q: np.ndarray, places: int) -> np.ndarray:
    """Products of rows of ``v`` and of ``q``, rounded as Spark's ``round`` does it with sums in component order.

    A matrix product adds in another order, so where its last bits might decide, the sum is made again in order.
    """
    with np.errstate(all="ignore"):
        products = v @ q.T
        scale = 10.0**places
        scaled = np.abs(products) * scale
        out = np.rint(products * scale) / scale
        least = scale * 1e-12 * (np.abs(v) @ np.abs(q.T)) + scaled * 1e-12
        i, j = np.nonzero((np.abs(scaled - np.floor(scaled) - 0.5) <= least) | ~(scaled <= 2.0**50))
        exact = np.zeros(len(i))
        for d in range(v.shape[1]):
            exact = exact + v[i, d] * q[j, d]
    if len(i):
        unit = Decimal(1).scaleb(-places)
        out[i, j] = [float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP, WIDE)) if np.isfinite(x) else x for x in exact.tolist()]
    return out + 0.0  # no negative zero


def _all_pairs(asked: list[tuple], places: int):
    """A query or vector that is null or has a null, and two of different lengths, have no score."""
    query_ids = [q for q, _ in asked]
    lengths = np.asarray([-1 if v is None or None in v else len(v) for _, v in asked])
    matrices = {n: np.asarray([asked[j][1] for j in np.flatnonzero(lengths == n)], dtype=np.float64).reshape(int(np.sum(lengths == n)), n) for n in set(lengths.tolist()) - {-1}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_PAIRS // len(query_ids))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                own = batch.column("vector")
                some = own.flatten()
                sizes = pc.fill_null(pc.list_value_length(own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                if some.null_count:
                    bad = np.asarray([x is not None and None in x for x in own.to_pylist()])
                else:
                    bad = np.zeros(len(sizes), bool)
                found, none = np.zeros((len(sizes), len(query_ids))), np.ones((len(sizes), len(query_ids)), bool)
                for n, matrix in matrices.items():
                    r, c = np.flatnonzero((sizes == n) & ~bad), np.flatnonzero(lengths == n)
                    if len(r):
                        v = own.take(pa.array(r)).flatten().to_numpy(zero_copy_only=False).reshape(len(r), n)
                        found[np.ix_(r, c)], none[np.ix_(r, c)] = _half_up(v, matrix, places), False
                k = len(query_ids)
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(sizes)), k)))
                names = pa.array(query_ids).take(pa.array(np.tile(np.arange(k), len(sizes))))
                yield pa.RecordBatch.from_arrays([names, ids, pa.array(found.ravel(), mask=none.ravel())], names=["query_id", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None, places: int = PLACES) -> DataFrame:
    """(query_id, [by,] id, score, rank): the best ``k`` vectors of each query, within ``by`` if given.

    Blocks of queries go to the tasks as matrices of bounded size. A task multiplies its batches with
    them and hands on only what may be among the best, so no row for each pair is made.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    rows = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), group.alias("_group"))
    kind = dict(queries.dtypes)["query_id"]
    numbered = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    schema = f"query_id {kind}, id {dict(vectors.dtypes)['id']}, _group string, score double"
    out = None
    for block in range(blocks):
        asked = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if asked:
            part = rows.mapInArrow(_multiplier([r["query_id"] for r in asked], np.asarray([r["vector"] for r in asked]), k, places), schema)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    ranked = top_k(out.withColumn("score", F.round("score", places)), k, "query_id", "_group")
    chosen = [F.col("_group").cast(dict(vectors.dtypes)[by]).alias(by)] if by else []
    return ranked.select("query_id", *chosen, "id", "score", "rank")


def _multiplier(query_ids: list, matrix: np.ndarray, k: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.asarray(batch.column("_group").fill_null("").to_pylist())
            values = batch.column("vector")
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                v = values.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                scores = np.round(v @ matrix.T, places)
                least = min(k, len(own))
                cut = np.partition(scores, len(own) - least, axis=0)[len(own) - least]
                at, q = np.nonzero(scores >= cut)
                ids = batch.column("id").take(pa.array(own[at]))
                asked = pa.array([query_ids[i] for i in q])
                yield pa.RecordBatch.from_arrays([asked, ids, pa.array([str(g)] * len(at)), pa.array(scores[at, q])], names=["query_id", "id", "_group", "score"])

    return run


def top_k(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The best ``k`` rows within ``by`` by score, ties to smaller ids."""
    window = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def reusable(stored: DataFrame, records: DataFrame, dimension: int) -> DataFrame:
    """Stored vectors whose record is unchanged."""
    return stored.where(F.size("vector") == dimension).join(records.select("id", "content_hash"), ["id", "content_hash"], "left_semi")


def signature() -> list[Column]:
    """Aggregates for :func:`signed`."""
    return [F.count("*").alias("n"), *[F.sum(F.xxhash64("id", "content_hash", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]]


def signed(row) -> tuple[int, str]:
    """How many records there are, and a digest of their (id, content_hash) in any order, from a row of :func:`signature`."""
    return row["n"], ":".join(str(int(row[f"h{k}"] or 0) % (1 << 64)) for k in (0, 1))


def signed_after(before: tuple[int, str], come: tuple[int, str], gone: tuple[int, str]) -> tuple[int, str]:
    """What :func:`signed` gives for records after some came and some went."""
    halves = zip(*(x[1].split(":") for x in (before, come, gone)), strict=True)
    return before[0] + come[0] - gone[0], ":".join(str((int(a) + int(b) - int(c)) % (1 << 64)) for a, b, c in halves)


def mean_pool(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, vector): the mean of each group's token vectors whose ``mask`` is not 0, as a unit vector.

    ``tokens`` has keys, mask and vector. A group without any such token gives a vector of zeros.
    """
    own = F.when(F.coalesce(F.col("mask"), F.lit(0)) != 0, 1.0).otherwise(0.0)
    parts = tokens.select(*keys, own.alias("own"), F.posexplode("vector").alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.sum(F.col("own") * F.col("x").cast("double")).alias("s"), F.sum("own").alias("n"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)
    lists = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", mean.alias("x")))).alias("v"))
    return lists.select(*keys, normalize(F.col("v.x")).alias("vector"))


def to_embed(records: DataFrame, stored: DataFrame, dimension: int) -> DataFrame:
    """Records without a vector to reuse."""
    have = stored.where(F.size("vector") == dimension).select("id", "content_hash")
    return records.join(have, ["id", "content_hash"], "left_anti")
