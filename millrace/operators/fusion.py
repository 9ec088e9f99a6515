"""Weighted reciprocal-rank fusion of retrieval channels, and the freshness lattice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OFFSET = 60.0
EXACT_BUCKET = 1.0
PLACES = 9
# Channels in tie order, and their weights by mode.
CHANNELS = ["Exact", "Lexical", "Vector", "CodeMap", "Symbol"]
WEIGHTS = {
    "balanced": [1.0, 1.0, 0.95, 0.8, 0.8],
    "current": [1.0, 1.0, 0.7, 0.6, 0.9],
    "design": [1.0, 0.7, 0.85, 1.0, 0.95],
}
# Freshness from best to worst; the worst one of a set holds.
FRESHNESS = ["NotConfigured", "Current", "Stale", "Degraded"]


def weights(spark: SparkSession) -> DataFrame:
    """(mode, channel, weight, channel_order)."""
    rows = [(mode, c, w, i) for mode, ws in WEIGHTS.items() for i, (c, w) in enumerate(zip(CHANNELS, ws, strict=True))]
    return spark.createDataFrame(rows, "mode string, channel string, weight double, channel_order int")


def by_channel(mode: Column, channel: Column) -> Column:
    """The weight as an expression, so no join is needed."""
    out = F.lit(None).cast("double")
    for m, ws in WEIGHTS.items():
        for c, w in zip(CHANNELS, ws, strict=True):
            out = F.when((mode == m) & (channel == c), w).otherwise(out)
    return out


def order_of(channel: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), channel) - 1


def rank_in_channel(hits: DataFrame, *order: Column) -> DataFrame:
    """Adds ``pos``, from 1, within (query_id, channel)."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(*order)))


def fuse(candidates: DataFrame, mode: str = "balanced") -> DataFrame:
    """(query_id, id, channel, exact, score, rank) from (query_id, channel, id, pos).

    Raw scores play no part. The channel is the exact one if there, else that of the highest weight.
    A channel's share is one term, and terms are added in channel order, so scores do not depend on row
    order; sums by channel are plain hash aggregates with partial sums.
    """
    has_provenance = "provenance" in candidates.columns
    cases = " ".join(f"WHEN '{c}' THEN {w}D" for c, w in zip(CHANNELS, WEIGHTS[mode], strict=True))
    listed = ", ".join(f"'{c}'" for c in CHANNELS)
    rows = candidates.withColumns({"weight": F.expr(f"CASE channel {cases} END"), "o": F.expr(f"array_position(array({listed}), channel) - 1")})
    strength = F.struct((F.col("channel") == "Exact").alias("e"), F.col("weight").alias("w"), (-F.col("o")).alias("o"))
    aggregates = [
        *[F.expr(f"coalesce(sum(CASE WHEN channel = '{c}' THEN weight / ({OFFSET}D + pos) END), 0.0D)").alias(f"_{c}") for c in CHANNELS],
        F.bool_or(F.col("channel") == "Exact").alias("exact"),
        F.max_by("channel", strength).alias("channel"),
    ]
    if has_provenance:
        aggregates.append(F.min_by("provenance", F.when(F.col("provenance").isNotNull(), F.col("o"))).alias("provenance"))
    fused = rows.groupBy("query_id", "id").agg(*aggregates)
    calibrated = F.round(reduce(lambda a, b: a + b, [F.col(f"_{c}") for c in CHANNELS]), PLACES)
    fused = fused.withColumn("calibrated", calibrated)
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("calibrated"), "id")
    score = F.round(F.col("calibrated") + F.when(F.col("exact"), EXACT_BUCKET).otherwise(0.0), PLACES)
    columns = ["query_id", "id", "channel", "exact", score.alias("score"), F.row_number().over(order).alias("rank")]
    return fused.select(*columns, *(["provenance"] if has_provenance else []))


def fuse_by_raw_score(hits: DataFrame) -> DataFrame:
    """The older order: raw score, then channel, then id; one row for each hit."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), order_of(F.col("channel")), "id")
    return hits.withColumn("rank", F.row_number().over(order))


def freshness_ordinal(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in FRESHNESS]), label) - 1


def merge_freshness(labels: Column) -> Column:
    """An aggregate: the worst label of a group."""
    return F.element_at(F.array(*[F.lit(x) for x in FRESHNESS]), (F.max(freshness_ordinal(labels)) + 1).cast("int"))


def lifecycle(state: str, lexical: str, lexical_generation: int | None, generation: int) -> str:
    """A runtime's freshness from the state's and the lexical projection's."""
    if state == "Degraded":
        return "Degraded"
    if lexical == "Current" and lexical_generation == generation:
        return "Current"
    return "Degraded" if lexical == "Degraded" else "Stale"
