"""Session helpers: table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a scale-factor folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. A temporary one stands in only
    where Spark runs in one process; a cluster must name its own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="postforge-checkpoint-"))
    return sc.getCheckpointDir()


#: Rows and bytes of an Arrow batch: texts may be long, and a batch is held whole on both sides.
BATCH_ROWS = 1500
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, unless the session asks for less."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        asked = spark.conf.get(name, None)
        if asked is None or not asked.isdigit() or not 0 < int(asked) <= most:
            spark.conf.set(name, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable (replicated by the store, not by executors), so a lost executor
    never costs more than the stage at hand.
    """
    checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(spark: SparkSession) -> int:
    """Tasks that row work is dealt to where little input makes much work."""
    return max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)


#: Distinct keys whose derived columns a broadcast may hold.
ONCE_ROWS = 20_000


def once(df: DataFrame, keys: list[str], derive: Callable[[DataFrame], DataFrame], most: int = ONCE_ROWS) -> DataFrame:
    """``df`` with the columns that ``derive`` adds to ``keys``, worked out once
    for each distinct value of the keys (nulls are values) and dealt to all
    cores. Few values, as counted, are broadcast; more are joined by a shuffle.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/once-{uuid.uuid4().hex}"
    derive(df.select(*keys).distinct().repartition(tasks(spark), *keys)).write.parquet(path)
    found = spark.read.parquet(path)
    few = found.count() <= most
    found = found.withColumnsRenamed({k: f"__once_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__once_{k}")) for k in keys])
    return df.join(F.broadcast(found) if few else found, same).drop(*[f"__once_{k}" for k in keys])


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` written once per session as parquet in the shared folder.

    Layers that many queries read are tables, as they would be in production:
    readers get pushed filters and pruned columns, and their plans stay small.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
