"""Path trees: counts rolled up to ancestors, deepest registered ancestor, nested candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """A directory path and all above it, '' for the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def roll_up(directories: DataFrame, *counts: str) -> DataFrame:
    """(directory, counts...) with every directory's counts added to its ancestors'."""
    rows = directories.select(F.explode(ancestors(F.col("directory"))).alias("directory"), *counts)
    return rows.groupBy("directory").agg(*[F.sum(c).alias(c) for c in counts])


def markdown_dominant(markdown: Column, total: Column) -> Column:
    """More than four fifths of the files are Markdown."""
    return (markdown > 0) & (markdown * 5 > total * 4)


def deepest_ancestor(paths: DataFrame, registered: DataFrame) -> DataFrame:
    """(path, prefix): the longest registered prefix of each path.

    Each path offers its own prefixes to an equi-join, so no path meets every prefix.
    """
    offered = paths.select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    found = offered.join(registered.select("prefix").distinct(), "prefix")
    return found.groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def remove_nested(candidates: DataFrame) -> DataFrame:
    """Candidates below no other one; the root alone counts only if nothing else is there."""
    rows = candidates.select("directory").distinct()
    inner = rows.where("directory <> ''")
    tops = inner if not inner.isEmpty() else rows
    above = tops.select(F.col("directory").alias("own"), F.explode(ancestors(F.col("directory"))).alias("directory")).where("own <> directory")
    nested = above.join(tops, "directory", "left_semi").select(F.col("own").alias("directory")).distinct()
    return tops.join(nested, "directory", "left_anti")


def page(rank: Column, size: int = 5) -> Column:
    """The page of a result number."""
    return F.ceil(rank / size).cast("int")


def numbered(df: DataFrame, *order: Column, by: list[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
