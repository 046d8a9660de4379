"""The action log as a stream: folded into the store batch by batch, and tumbling counts.

The store keeps of each field its last value and when it was set, so a batch is
folded by itself and meets only the buckets of its jobs; replayed batches are
told by their name in the run log and change nothing.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postforge.operators import runs
from postforge.operators.state import ALIASES, TOUCHES, fold_actions

LOG_SCHEMA = "id long, job_id string, action_type string, action_value string, notes string, created_at timestamp, updated_at timestamp"


def read_log(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def start_fold(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Current state of every job in an in-memory table, for small logs and tests; :func:`stream_into` is the way to a store."""
    return fold_actions(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


# --- the store of states ------------------------------------------------------------------

_AT = "struct(created_at, id)"


def partial_states(log: DataFrame) -> DataFrame:
    """STATE-02 in parts that can be merged: of each field when it was last set and to what."""
    fields = [F.max(F.expr(f"case when {test} then struct({_AT} as at, {value} as value) end")).alias(name) for name, (test, value) in TOUCHES.items()]
    return log.groupBy("job_id").agg(*fields, F.max(F.expr(f"struct({_AT} as at, updated_at as value)")).alias("updated_at"), F.min("created_at").alias("created_at"), F.count("*").alias("n_actions"))


def merge_states(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Field by field the later value."""
    both = current.select("*", F.lit(0).alias("new")).unionByName(incoming.select("*", F.lit(1).alias("new")))
    latest = [F.max(c).alias(c) for c in (*TOUCHES, "updated_at")]
    out = both.groupBy(key).agg(*latest, F.min("created_at").alias("created_at"), F.sum("n_actions").alias("n_actions"), F.min("new").alias("lo"), F.max("new").alias("hi"))
    kind = F.when(F.col("hi") == 0, "K").when(F.col("lo") == 1, "I").otherwise("U")
    return out.withColumns({"_merge": kind, "_changed": F.col("lo") < F.col("hi")}).drop("lo", "hi")


def states(spark: SparkSession, path: str) -> DataFrame | None:
    """STATE-02: one row a job, as :func:`fold_actions` gives it; None before any."""
    held = runs.jobs(spark, path)
    return None if held is None else held.select("job_id", *[F.col(f"{c}.value").alias(c) for c in TOUCHES], "created_at", F.col("updated_at.value").alias("updated_at"), "n_actions")


def fold_batch(batch: DataFrame, path: str, name: str) -> bool:
    """Merge a batch into the store once, whatever number of times it comes."""
    spark = batch.sparkSession
    done = runs.run_log(spark, path).where(F.col("status").isin(*runs.COMPLETED) & (F.col("trigger") == name))
    if not done.isEmpty():
        return False
    runs.write_run(partial_states(batch), path, "actions", name, merge=merge_states)
    return True


def stream_into(log: DataFrame, path: str, checkpoint: str, name: str = "actions") -> StreamingQuery:
    """STATE-08: the stream's new actions, batch by batch, into the store at ``path``."""
    return log.writeStream.foreachBatch(lambda batch, i: fold_batch(batch, path, f"{name}:{i}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class UnknownJob(LookupError):
    """An action for a job that is not there."""


def record_action(jobs: DataFrame, path: str, job_id: str, action: str, value: str | None = None, notes: str | None = None) -> dict:
    """STATE-08: set one action or the notes of a job and return its fresh record,
    the job's columns and its state; UnknownJob if ``jobs`` has no such job."""
    spark = jobs.sparkSession
    found = jobs.where(F.col("job_id") == job_id).limit(1)
    if found.isEmpty():
        raise UnknownJob(job_id)
    now = datetime.now(timezone.utc)
    number = runs.run_log(spark, path).count()
    row = spark.createDataFrame([(number, job_id, ALIASES.get(action, action), value, notes, now, now)], LOG_SCHEMA)
    fold_batch(row, path, f"write:{number}:{now.isoformat()}")
    own = states(spark, path).where(F.col("job_id") == job_id).withColumnRenamed("notes", "action_notes")
    return found.join(own.drop("created_at", "updated_at"), "job_id", "left").first().asDict(recursive=True)


# --- extensions --------------------------------------------------------------------------------


def tumbling_counts(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Extension: actions per type and window, late rows dropped by watermark."""
    return log.withWatermark("created_at", late).groupBy(F.window("created_at", window), "action_type").count()


def distinct_actions(log: DataFrame, late: str = "2 days") -> DataFrame:
    """Extension: the log without repeated ids within the watermark."""
    return log.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
