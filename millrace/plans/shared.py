"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where a local session leaves it unset, as tests
do, one temporary folder is made for the process; on a cluster that is an error, as executors share no local folder.
Tables that a lazy result still reads live until :func:`release`, or the end of the process, which calls it.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_written: dict[str, set[str]] = {}
_CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def shared_root(spark: SparkSession) -> str:
    """The shared folder: the session's checkpoint folder, or one of our own where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return str(root)
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path under the shared folder, which :func:`release` removes with what is in it."""
    path = f"{shared_root(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialize(df: DataFrame, label: str, compression: str = "zstd", batch_rows: int = 500) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: later jobs reread whole files that outlive any executor. The shuffle files
    of the job are of no more use then, so Spark is told to delete them when the write has ended.
    Python functions in the plan get ``batch_rows`` rows at a time, which bounds what long texts take.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    now = dict.fromkeys(_CLEANUP, "true") | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}
    before = {key: spark.conf.get(key, None) for key in now}
    for key, value in now.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    return out


def remove(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = df_or_path if isinstance(df_or_path, str) else getattr(df_or_path, "millrace_path", None)
    if path is None:
        return
    spark = spark or SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables and other paths of this application; how many. No result of before may be read after."""
    left = sorted(_written.get(spark.sparkContext.applicationId, ()))
    for path in left:
        remove(path, spark)
    return len(left)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the process ends anyway, and the JVM may be gone
            release(spark)


def with_facts(rows: DataFrame, groups: DataFrame, *keys: str, hot: int = 256, most: int = 500_000) -> DataFrame:
    """``rows`` joined with their groups' facts. ``groups`` is a written table with each group's size ``n``.

    Rows of groups with over ``hot`` members are not dealt by key, if those groups' facts are at most ``most``
    rows, which are broadcast. Otherwise adaptive execution splits what is skewed.
    """
    large = groups.where(F.col("n") > hot)
    few = large.count()
    if not few or few > most:
        return rows.join(groups, [*keys])
    cold = rows.join(F.broadcast(large.select(*keys)), [*keys], "left_anti").join(groups.where(F.col("n") <= hot), [*keys])
    return rows.join(F.broadcast(large), [*keys]).unionByName(cold)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: small inputs come as one file.

    Larger inputs have more partitions than that, and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``, in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
