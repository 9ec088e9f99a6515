"""Hard negatives by bit-sliced integer products: rows of other labels that score just below an anchor's positives.

Bit-slices. Components are whole numbers; a block of rows keeps, for each bit, a plane with that bit of every component,
the sign's plane first. An anchor's product with a plane is a sum of the anchor's components where the bit is set, so the planes
from the most significant down to bit k give the product but for a rest between (2^k - 1) times the sum of the anchor's
negative components and as much of its positive ones. These bounds are a pair's score interval. Each further plane makes it
about half as wide, and a pair is dropped as soon as its interval cannot qualify: it lies outside all windows of its
anchor, or below scores that enough rows surely have or had before. What is left after the last plane has its exact score.
While many pairs are left a plane is multiplied with all anchors of a group at once; later only with the pairs left.

Two passes share this: positives are the best rows of the anchor's own label (one window without ends);
negatives are the best rows of other labels in a window for each positive, from LOW to HIGH hundredths of its score.

Scale. Anchors are a stated query set, dealt in blocks of ANCHORS; a block, and later its windows, is all that is
broadcast. Every row is scanned for a block by bit-planes written once, so there is no pair join. A task hands on its best few
rows for each anchor and window; Spark ranks those of all tasks.

Defined results: rows with a null id, label or vector, with null or non-finite components, or with another vector length than
most take no part. Of rows with one id the one with the smallest label, then the smallest vector, counts. Components are clamped as
:mod:`integers` says. Equal scores go to the smaller id. An anchor without positives, or whose window is empty (its positive's
score is negative), gives no rows. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.integers import floored
from millrace.plans.shared import materialize, remove

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Anchors in a block, which one job broadcasts; anchors whose pairs a task holds at a time; rows of a scan.
ANCHORS, GROUP, SCAN = 8192, 64, 4096
#: Pairs are listed one by one once at most this share of a group's pairs is left.
LISTED = 1 / 8
#: At this bit, while pairs are not listed yet, scores that rows surely have are looked at.
SURE_BIT = 3
LEAST, MOST = -(1 << 62), 1 << 62


def top(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each key, by key, score downwards and id."""
    order = np.lexsort((ids, -score, key))
    own = key[order]
    order = order[np.arange(len(own)) - np.searchsorted(own, own) < k]
    return key[order], score[order], ids[order]


def kth(key: np.ndarray, score: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th best score of each of ``n`` keys, LEAST where there are fewer."""
    out = np.full(n, LEAST, score.dtype if score.dtype == np.int64 else np.float64)
    order = np.lexsort((-score, key))
    own = key[order]
    last = order[np.arange(len(own)) - np.searchsorted(own, own) == k - 1]
    out[key[last]] = score[last]
    return out


class Planes:
    """The bit-planes of a block of rows, unpacked one at a time."""

    def __init__(self, packed: np.ndarray, d: int, kind: type) -> None:
        self.packed, self.d, self.kind = packed, d, kind

    def plane(self, at: int) -> np.ndarray:
        return np.unpackbits(self.packed[at], axis=1, count=self.d).astype(self.kind)


def sliced(v: np.ndarray, bits: int) -> np.ndarray:
    """Packed planes (bits + 1, rows, bytes) of whole numbers in [-2^bits, 2^bits): the sign, then the highest bit first."""
    return np.stack([np.packbits((v >> k) & 1, axis=1) if k < bits else np.packbits(v < 0, axis=1) for k in range(bits, -1, -1)])


def qualified(planes: Planes, bits: int, anchors: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, sure: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs that may be among the best ``k`` of a window.

    ``alive`` (rows, anchors) tells the pairs to look at; ``low``, ``high`` and ``sure`` (anchors, windows) are the windows' ends and the
    scores that k rows have already.
    """
    exact = np.float64 if float(anchors.shape[1]) * np.abs(anchors).max(initial=1) * 2.0**bits < 2**53 else np.int64
    a = anchors.astype(planes.kind if exact is np.float64 else np.int64)
    low, high, sure = low.astype(exact), high.astype(exact), sure.astype(exact)
    least, most = np.minimum(anchors, 0).sum(axis=1).astype(exact), np.maximum(anchors, 0).sum(axis=1).astype(exact)
    windows = low.shape[1]
    total, rows = np.zeros(alive.shape, exact), None
    for at, bit in enumerate(range(bits, -1, -1)):
        plane, weight, rest = planes.plane(at), exact(-(1 << bit) if not at else 1 << bit), exact((1 << bit) - 1)
        if rows is None:
            total += weight * (plane.astype(a.dtype) @ a.T).astype(exact)
            lower, upper = total + rest * least, total + rest * most
            alive &= (upper >= np.maximum(low, sure).min(axis=1)) & (lower <= high.max(axis=1))
            if bit == SURE_BIT and len(alive) > k:
                for w in range(windows):
                    within = np.where(alive & (lower >= low[:, w]) & (upper <= high[:, w]), lower, LEAST)
                    sure[:, w] = np.maximum(sure[:, w], np.partition(within, len(within) - k, axis=0)[len(within) - k])
                alive &= upper >= np.maximum(low, sure).min(axis=1)
            if alive.mean() <= LISTED or bit == 0:
                rows, columns = np.nonzero(alive)
                total = total[rows, columns]
            continue
        step = max(1, (1 << 22) // max(1, plane.shape[1]))
        for x in range(0, len(rows), step):
            part = slice(x, x + step)
            total[part] += weight * (plane[rows[part]].astype(a.dtype) * a[columns[part]]).sum(axis=1).astype(exact)
        lower, upper = total + rest * least[columns], total + rest * most[columns]
        stays = np.zeros(len(rows), bool)
        for w in range(windows):
            certain = np.flatnonzero((lower >= low[columns, w]) & (upper <= high[columns, w]))
            sure[:, w] = np.maximum(sure[:, w], kth(columns[certain], lower[certain], k, len(a)))
            stays |= (upper >= np.maximum(low, sure)[columns, w]) & (lower <= high[columns, w])
        rows, columns, total = rows[stays], columns[stays], total[stays]
    return rows, columns, total.astype(np.int64)


def slices(vectors: DataFrame, d: int, bits: int) -> DataFrame:
    """Blocks of up to SCAN rows of ``vectors`` (id, label, v): ids, labels and bit-planes as packed bytes."""

    def block(ids: list, labels: list, v: list) -> pa.RecordBatch:
        planes = sliced(np.concatenate(v), bits)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(ids), np.concatenate(labels), planes)], names=["ids", "labels", "planes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, v, n = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN):
                part = batch.slice(at, SCAN)
                if n and n + part.num_rows > SCAN:
                    yield block(ids, labels, v)
                    ids, labels, v, n = [], [], [], 0
                ids.append(part.column("id").to_numpy())
                labels.append(part.column("label").to_numpy())
                v.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d))
                n += part.num_rows
        if n:
            yield block(ids, labels, v)

    return vectors.select("id", "label", "v").mapInArrow(run, "ids binary, labels binary, planes binary")


def searched(blocks: DataFrame, d: int, bits: int, shared, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, id, score): each task's best ``k`` of each window; ``shared`` holds the anchors and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, anchors, low, high = shared.value
        windows = low.shape[1]
        none = (np.zeros(0, np.int64),) * 3
        best = {at: none for at in range(0, len(a_ids), GROUP)}
        kind = np.float32 if np.abs(anchors).sum(axis=1).max(initial=0) < 1 << 24 else np.float64
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                planes = Planes(np.frombuffer(row["planes"], np.uint8).reshape(bits + 1, len(ids), -1), d, kind)
                for at, (keys, scores, found) in best.items():
                    own = slice(at, at + GROUP)
                    lo, hi, a = low[own], high[own], anchors[own]
                    sure = kth(keys, scores, k, len(a) * windows).reshape(len(a), windows)
                    alive = ((labels[:, None] == a_labels[own]) == same) & (ids[:, None] != a_ids[own])
                    rows, columns, total = qualified(planes, bits, a, alive, lo, hi, sure, k)
                    for w in range(windows):
                        inside = (total >= lo[columns, w]) & (total <= hi[columns, w])
                        keys = np.concatenate([keys, columns[inside] * windows + w])
                        scores = np.concatenate([scores, total[inside]])
                        found = np.concatenate([found, ids[rows[inside]]])
                    best[at] = top(keys, scores, found, k)
        for at, (keys, scores, found) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(a_ids[at + keys // windows]), pa.array((keys % windows).astype(np.int32)), pa.array(found), pa.array(scores)], names=["anchor_id", "window", "id", "score"])

    found = blocks.mapInArrow(run, "anchor_id long, window int, id long, score long")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def windows_of(scores: list[int | None], low: int, high: int) -> tuple[list[int], list[int]]:
    """The least and greatest negative scores for each positive's score; an empty window where there is none."""
    ends = [(-(-low * s // 100), high * s // 100) if s is not None else (MOST, LEAST) for s in scores]
    ends = [(a, b) if a <= b else (MOST, LEAST) for a, b in ends]
    return [a for a, _ in ends], [b for _, b in ends]


def mine(rows: DataFrame, is_anchor: str, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has id, label and v; ``is_anchor`` is a condition on id.
    """
    spark = rows.sparkSession
    known = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v").where("id IS NOT NULL AND label IS NOT NULL")
    whole, d = floored(known, scale)
    once = whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    kept = materialize(once, "vectors")
    span = lambda x: F.greatest(x, -x - 1)
    bits = int(kept.agg(F.max(F.array_max(F.transform("v", span)))).first()[0] or 0).bit_length()
    blocks = materialize(slices(kept, d, bits), "planes")
    anchors = kept.where(is_anchor)
    parts = max(1, -(-anchors.count() // ANCHORS))
    dealt = materialize(anchors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition(F.col("part")), "anchors") if parts > 1 else anchors.withColumn("part", F.lit(0))
    out = None
    for part in range(parts):  # a job for each block of anchors, which is all that the driver holds
        own = dealt.where(F.col("part") == part).orderBy("id").collect()
        if not own:
            continue
        ids, labels = (np.asarray([r[c] for r in own], np.int64) for c in ("id", "label"))
        v = np.asarray([r["v"] for r in own], np.int64).reshape(len(own), d)
        everything = np.full((len(own), 1), LEAST), np.full((len(own), 1), MOST)
        shared = spark.sparkContext.broadcast((ids, labels, v, *everything))
        best = searched(blocks, d, bits, shared, True, positives).collect()  # at most ``positives`` rows an anchor
        shared.destroy()
        place = {int(x): n for n, x in enumerate(ids)}
        scores = [[None] * positives for _ in own]
        for r in best:
            scores[place[r["anchor_id"]]][r["rank"] - 1] = r["score"]
        ends = [windows_of(x, low, high) for x in scores]
        shared = spark.sparkContext.broadcast((ids, labels, v, *(np.asarray([x[i] for x in ends], np.int64) for i in (0, 1))))
        found = searched(blocks, d, bits, shared, False, negatives)
        chosen = spark.createDataFrame([(r["anchor_id"], r["rank"] - 1, r["id"], r["score"]) for r in best], "anchor_id long, window int, positive_id long, positive_score long")
        found = found.join(F.broadcast(chosen), ["anchor_id", "window"])  # as many rows as ``best``
        found = materialize(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    remove(blocks), remove(kept)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


ORACLE_SQL = f"""
WITH k AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, anchors at ids divisible by 100; where 7 divides the id, the label is the next one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"))
    return mine(rows, "id % 100 = 0")
