"""Reconciling a new scan with durable state: changes by id and content hash, and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change(old_hash: Column, new_hash: Column) -> Column:
    return F.when(old_hash.isNull(), "add").when(new_hash.isNull(), "delete").when(old_hash == new_hash, "unchanged").otherwise("change")


def diff(old: DataFrame, new: DataFrame, *scope: str) -> DataFrame:
    """(scope..., id, state_change) of all records, by a full outer join on id, within ``scope``."""
    keys = [*scope, "id"]
    o = old.select(*keys, F.col("content_hash").alias("old_hash"))
    n = new.select(*keys, F.col("content_hash").alias("new_hash"))
    return o.join(n, keys, "full").select(*keys, change(F.col("old_hash"), F.col("new_hash")).alias("state_change"))


def replaced(old: DataFrame | None, new: DataFrame, columns: list[str]) -> DataFrame:
    """Old rows joined with their new selves by id: ``new``'s columns, state_change, and whether a row was, is, and differs.

    ``state_change`` goes by content hash; rows differ if any column does. Without ``old`` rows all are added, and none is joined.
    """
    if old is None:
        yes = F.lit(True)
        return new.select(*columns, F.lit("add").alias("state_change"), F.lit(False).alias("was"), yes.alias("is"), yes.alias("differs"))
    row = F.xxhash64(F.to_json(F.struct(*columns)))
    o = old.select("id", F.col("content_hash").alias("_old_hash"), row.alias("_old_row"))
    n = new.select(*columns, row.alias("_row"))
    return o.join(n, "id", "full").select(
        *columns, change(F.col("_old_hash"), F.col("content_hash")).alias("state_change"), F.col("_old_row").isNotNull().alias("was"), F.col("_row").isNotNull().alias("is"), (~F.col("_old_row").eqNullSafe(F.col("_row"))).alias("differs")
    )


def removed_sources(known: DataFrame, seen: DataFrame, key: str = "source_key") -> DataFrame:
    return known.join(seen, key, "left_anti")


def changed_sources(seen: DataFrame, known: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Sources to parse again: those of another hash, and those forced."""
    out = seen.join(known.select("source_key", "file_hash"), ["source_key", "file_hash"], "left_anti")
    if forced is not None:
        out = out.unionByName(seen.join(forced, "source_key", "left_semi")).dropDuplicates(["source_key"])
    return out


def ownership_conflicts(owned: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records whose id another source owns already."""
    o = owned.select(F.col("id").alias("owned_id"), F.col("source_key").alias("owner"))
    return incoming.join(o, (F.col("id") == F.col("owned_id")) & (F.col("owner") != F.col("source_key")), "left_semi")


def membership_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one side alone, with ``side``; columns are compared as sets of rows."""
    gone = old.exceptAll(new).withColumn("side", F.lit("old"))
    come = new.exceptAll(old).withColumn("side", F.lit("new"))
    return gone.unionByName(come)


def duplicate_ids(records: DataFrame, column: str = "id") -> DataFrame:
    return records.groupBy(column).agg(F.count("*").alias("copies")).where("copies > 1")


def next_generation(changes: DataFrame, generation: int, membership_changed: bool = False) -> int:
    """One more if anything changed."""
    touched = membership_changed or not changes.where("state_change <> 'unchanged'").isEmpty()
    return generation + int(touched)
