"""Mixing sources to target weights by cube-method balanced sampling.

Targets. Sources in order of code points, null last, have the weights WEIGHTS, repeating. They share SHARE times the size
of everything in proportion to weight, but none gets over MOST times its own size; what is over is shared again by weight among
the others until none is above. So each document is wanted target / size of source times: its whole part are sure copies,
the rest an inclusion probability.

Flight. Documents of a source lie in small groups by hash. In a group three fractional documents at a time are moved
along the null space of the two constraints, the sum of sizes and the number of documents, by steps drawn so that each
probability stays right on average, until one is 0 or 1. Each group so ends with at most two fractional ones, with
its token and document totals as they were. These meet in groups of FAN groups, and so on, until a source has one group.

Landing. Beside the last two a source keeps back about POOL documents of each power of two of sizes. They are rounded
from the largest down, each to the side that brings the tokens nearer to the target, so large documents' errors are made up by
smaller ones, and what is left is about half of a small document.

Scale. One aggregate by source and power of two has all that is known of sources; targets are found by a few more
over sources. Documents are three numbers each, and no group or task has all of a source. Draws come from hashes of id
and text, so a rerun agrees, whatever the partitions.

Defined results: null and empty texts have size 0, are taken in like manner, and count 0. A source of size 0 has target
0. Repeated rows count each. Ties in order go to the smaller hash, then the smaller id. Very long texts are counted whole.
Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.shared import materialize, remove, spread, with_facts

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a first group, about; groups whose rests meet in one of the next; documents of each power of two kept for the landing, about.
GROUP, FAN, POOL = 128, 64, 8
EPSILON = 1e-9

UNITS = "doc_id long, size long, source_no long, bucket long, h long, u double, psi double, copies int, pool boolean"
COLUMNS = [x.split()[0] for x in UNITS.split(", ")]


def numbered(sources: DataFrame, *order) -> DataFrame:
    """``sources`` with ``no``, from 0 in the given order, without one task that has them all."""
    ranged = materialize(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn("no", F.coalesce("_before", F.lit(0)) + F.expr("_at & 8589934591")).drop("_at", "_part", "_n", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``no`` and ``target``.

    Each turn finds what is above its bound when the rest is shared by weight; bounds once met stay met.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    rows = materialize(numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", weight), "weighed")
    bound = F.lit(most) * F.col("source_size")
    level, had = None, -1
    while True:
        full = F.lit(False) if level is None else bound <= F.col("weight") * level
        r = rows.agg(F.sum("source_size").alias("all"), F.count_if(full).alias("n"), F.sum(F.when(full, bound)).alias("over"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if r["n"] == had or not r["w"]:
            break
        had, level = r["n"], (share * (r["all"] or 0) - (r["over"] or 0)) / r["w"]
    target = bound if level is None else F.least(bound, F.col("weight") * F.lit(level))
    return rows.withColumn("target", target.cast("double")).drop("weight")


def step(units: list[list]) -> None:
    """Moves three fractional units [psi, size, ...] along the null space, by the draw of the last, until one is whole."""
    a, b, c = (x[1] for x in units)
    move = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
    up = min((1 - x[0]) / m if m > 0 else x[0] / -m for x, m in zip(units, move, strict=True) if m)
    down = min(x[0] / m if m > 0 else (1 - x[0]) / -m for x, m in zip(units, move, strict=True) if m)
    far = up if units[-1][2] * (up + down) < down else -down
    for x, m in zip(units, move, strict=True):
        x[0] += far * m
        x[0] = 0.0 if x[0] < EPSILON else 1.0 if x[0] > 1 - EPSILON else x[0]


def _grouped(run):
    """A function of rows sorted by (source_no, bucket) that gives ``run`` each group, and yields its columns again with new psi."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2:4] != key:
                    done += run(held)
                    key, held = row[2:4], []
                held.append(row)
            if done:
                yield _batch(done)
        if held:
            yield _batch(run(held))

    return over


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=COLUMNS)


def flight(rows: list[tuple]) -> list[tuple]:
    """The rows of one group with their probabilities moved until at most two are fractional."""
    out, open_ = [], []
    for row in rows:
        psi = row[6]
        if psi <= EPSILON or psi >= 1 - EPSILON:
            out.append((*row[:6], round(psi), *row[7:]))
            continue
        open_.append([psi, row[1], row[5], row])
        if len(open_) == 3:
            step(open_)
            out += [(*x[3][:6], x[0], *x[3][7:]) for x in open_ if x[0] in (0.0, 1.0)]
            open_ = [x for x in open_ if x[0] not in (0.0, 1.0)]
    return out + [(*x[3][:6], x[0], *x[3][7:]) for x in open_]


def landing(rows: list[tuple]) -> list[tuple]:
    """The rows of one source, largest first, rounded so that the tokens come near what they were."""
    out, error = [], 0.0
    for row in rows:
        psi, size = row[6], row[1]
        one = abs(error + (1 - psi) * size) < abs(error - psi * size) if size else row[5] < psi
        error += (float(one) - psi) * size
        out.append((*row[:6], float(one), *row[7:]))
    return out


def _by_group(units: DataFrame, run, *order) -> DataFrame:
    ordered = units.select(*COLUMNS).repartition("source_no", "bucket").sortWithinPartitions("source_no", "bucket", *order)
    return ordered.mapInArrow(_grouped(run), UNITS)


def mix(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of ``docs`` (doc_id, text and the source's column)."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), text.alias("text")))
    rows = rows.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    scale = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size"))) + 1).otherwise(0).cast("int")
    rows = materialize(rows.withColumn("scale", scale).withColumn("key", F.to_json(F.struct("source"))), "sizes")
    facts = rows.groupBy("key", "source", "scale").agg(F.count("*").alias("n"), F.sum("size").alias("size_sum"))
    facts = materialize(facts, "facts")
    sources = targets(facts.groupBy("key", "source").agg(F.sum("size_sum").alias("source_size"), F.sum("n").alias("source_n")), weights, share, most)
    sources = materialize(sources.drop("source"), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = facts.select("key", "scale", "n").join(sources, "key").withColumn("times", times)
    known = materialize(known, "known")
    all_ = with_facts(rows.drop("source"), known, "key", "scale")
    draw = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
    copies = F.floor(F.col("times") + EPSILON).cast("int")
    buckets = F.greatest(F.lit(1), F.col("source_n") / GROUP).cast("long")
    all_ = all_.select(
        "doc_id", "size", F.col("no").alias("source_no"), F.pmod(F.xxhash64("h", F.lit(1)), buckets).alias("bucket"), "h", draw(2).alias("u"),
        F.greatest(F.lit(0.0), F.col("times") - copies).alias("psi"), copies.alias("copies"), (draw(3) * F.col("n") < POOL).alias("pool"),
    )
    units = materialize(all_, "units")
    remove(rows), remove(known), remove(facts)
    largest = sources.agg(F.max("source_n")).first()[0] or 0
    fractional = (F.col("psi") > EPSILON) & (F.col("psi") < 1 - EPSILON)
    order = (F.desc("size"), "h", "doc_id")
    done, now = units.where(~fractional), units.where(fractional & ~F.col("pool"))
    groups = max(1, largest // GROUP)
    while True:
        flown = materialize(_by_group(now, flight, *order), "flown")
        done = done.unionByName(flown.where(~fractional))
        now = flown.where(fractional).withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        if groups == 1:
            break
        groups = -(-groups // FAN)
    last = now.unionByName(units.where(fractional & F.col("pool"))).withColumn("bucket", F.lit(0).cast("long"))
    done = done.unionByName(materialize(_by_group(last, landing, *order), "landed"))
    taken = (F.col("copies") + F.round("psi").cast("int")).alias("copies")
    facts = sources.select(F.col("no").alias("source_no"), "source_size", "target", F.col("source_n").alias("n"))
    out = with_facts(done.select("doc_id", "size", "source_no", taken), materialize(facts, "mix"), "source_no")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, mixed by source."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
