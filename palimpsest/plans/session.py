"""Session helpers shared by all operators: tables, parallelism, durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of parts."""
    # a pattern, because the source takes a path that is none for a folder
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(df: DataFrame, *keys) -> DataFrame:
    """Repartition only when the scan has fewer splits than the cluster has cores.

    Large inputs have many splits, so they are left where they are; a single small file
    would otherwise keep all but one core idle in a CPU-heavy stage.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys) if keys else df.repartition(2 * cores)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by the keys into a number that isn't reduced again for being small: for CPU-heavy steps behind a shuffle.

    An aggregate or join on the same keys that follows needs no other shuffle.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not own:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(own)
    return own.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, cutting the lineage.

    The files survive the loss of an executor; drop_written() removes them, at the latest when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written(keep: int = 0) -> None:
    """Removes what was written, but for the first `keep`."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder's owner cleans up
            pass


atexit.register(drop_written)


@contextmanager
def scoped() -> Iterator[None]:
    """What is written inside is removed at the end: for results that are read inside too, as those of a micro-batch."""
    before = len(_written)
    try:
        yield
    finally:
        drop_written(before)


#: A key that holds more than 1/HOT of all rows is a heavy hitter, so there are fewer than HOT of them.
HOT = 500


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of left with right, which has one row per key and in `count` the rows of left with it.

    Keys above total / HOT rows, of which there are fewer than HOT whatever the data, are joined by
    broadcast, so no task receives a hot key; the rest is joined by shuffle. `right` should be
    materialized, as it is read twice.
    """
    least = max(total // HOT, 1)
    hot, cold = right.filter(F.col(count) > least).drop(count), right.filter(F.col(count) <= least).drop(count)
    hot_keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(hot_keys, key, "left_anti").join(cold, key))
