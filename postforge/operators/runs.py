"""The store of runs: rows by key in hash buckets, their snapshots, and the run log.

A run reads and rewrites only the buckets its keys fall in, once, under
``rows/scan_run_id=N/bucket=B``, and then writes its manifest: which run holds
each bucket now, how many rows, under which layout. Readers follow the manifest
of the last run that the append-only log calls completed, so a run that dies or
is repeated is never half seen and needs no lock or rollback. One writer at a
time. Data files keep what the run did to each row, so snapshots are the same
files. The number of buckets is fixed by the first run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postforge.operators import state

LOG = "scan_run_id long, step int, status string, at timestamp, pack string, trigger string, counts map<string,long>, note string"
MANIFEST = "bucket int, held_by long, rows long, layout int, buckets int"
COMPLETED = ("completed", "completed_with_errors")
#: Buckets of a new store; rows of the log's error notes.
BUCKETS, NOTE = 64, 1000
#: STATE-01: a posting has changed when one of these has; those that a row lacks are passed over.
WATCHED = ("content_hash", "status", "status_confidence", "role_family", "role_confidence", "eligibility")

Merge = Callable[[DataFrame, DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Layout:
    """STATE-07: a version of the columns: those it adds (SQL over the rows of
    the version before), those it rewrites, then those it drops."""

    number: int
    adds: Mapping[str, str] = field(default_factory=dict)
    rewrites: Mapping[str, str] = field(default_factory=dict)
    drops: Sequence[str] = ()

    def of(self, rows: DataFrame) -> DataFrame:
        known = {c: F.expr(e).alias(c) for c, e in self.rewrites.items()}
        kept = [known.get(c, F.col(c)) for c in rows.columns]
        added = [F.expr(e).alias(c) for c, e in self.adds.items() if c not in rows.columns]
        return rows.select(*kept, *added).drop(*self.drops)


FIRST = (Layout(1),)


# --- log ----------------------------------------------------------------------------------


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log; none for a store that was never written."""
    return _table(spark, f"{path}/runs", LOG)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """STATE-06: each run as its last log row has it, with its start."""
    last = F.max_by(F.struct("status", "at", "pack", "trigger", "counts", "note"), "step").alias("r")
    return run_log(spark, path).groupBy("scan_run_id").agg(F.min("at").alias("started_at"), last).select("scan_run_id", "started_at", "r.*")


def _append(spark: SparkSession, path: str, *row) -> None:
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{path}/runs")


# --- reading --------------------------------------------------------------------------------


def manifest(spark: SparkSession, path: str, run: int | None = None) -> list:
    """The buckets as of ``run``, or of the last completed one: at most one row a bucket; none before any."""
    done = run_log(spark, path).where(F.col("status").isin(*COMPLETED))
    found = done.where(F.lit(True) if run is None else F.col("scan_run_id") == run).agg(F.max("scan_run_id")).first()[0]
    return [] if found is None else _table(spark, f"{path}/manifest/scan_run_id={found}", MANIFEST).collect()


def _read(spark: SparkSession, path: str, held: list, layouts: Sequence[Layout]) -> DataFrame | None:
    """Rows of manifest entries in the newest layout, with bucket, _merge and _changed."""
    parts = []
    for number in sorted({h.layout for h in held}):
        folders = [f"{path}/rows/scan_run_id={h.held_by}/bucket={h.bucket}" for h in held if h.layout == number]
        rows = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", True).parquet(*folders).drop("scan_run_id")
        if number > layouts[-1].number:
            raise ValueError(f"the store has layout {number}; the newest known is {layouts[-1].number}")
        for layout in layouts:
            if layout.number > number:
                rows = layout.of(rows)
        parts.append(rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def jobs(spark: SparkSession, path: str, run: int | None = None, layouts: Sequence[Layout] = FIRST) -> DataFrame | None:
    """SNK-07: rows as of ``run``, or of the last completed one, whatever layouts
    they were written under; None before any."""
    rows = _read(spark, path, [h for h in manifest(spark, path, run) if h.rows], layouts)
    return None if rows is None else rows.drop("bucket", "_merge", "_changed")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """STATE-04: every row as each completed run saw it."""
    done = run_log(spark, path).where(F.col("status").isin(*COMPLETED)).select("scan_run_id")
    rows = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", True).parquet(f"{path}/rows")
    return rows.where(F.col("_merge").isin("I", "U")).withColumnRenamed("_changed", "changed").drop("_merge", "bucket").join(done, "scan_run_id", "left_semi")


# --- writing --------------------------------------------------------------------------------


def merge_jobs(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """STATE-01 over the watched fields that the rows have."""
    merged = state.merge_runs(current, incoming, key, [c for c in WATCHED if c in incoming.columns and c in current.columns] or [key])
    return merged.withColumnsRenamed({"merge": "_merge", "changed": "_changed"})


def _run(incoming: DataFrame, path: str, pack: str, trigger: str, errors: int, key: str, merge: Merge, buckets: int, layouts: Sequence[Layout], everything: bool) -> dict[str, int]:
    spark = incoming.sparkSession
    now = lambda: datetime.now(timezone.utc)
    run = (run_log(spark, path).agg(F.max("scan_run_id")).first()[0] or 0) + 1
    _append(spark, path, run, 0, "running", now(), pack, trigger, None, None)
    try:
        before = {h.bucket: h for h in manifest(spark, path)}
        buckets = next(iter(before.values())).buckets if before else buckets
        place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        touched = set(before) if everything else {r[0] for r in incoming.select(place).distinct().collect()}  # numbers of buckets
        old = _read(spark, path, [before[b] for b in touched if b in before and before[b].rows], layouts)
        current = incoming.limit(0) if old is None else old.drop("bucket", "_merge", "_changed")
        merged = merge(current, incoming, key).withColumn("bucket", place)
        folder = f"{path}/rows/scan_run_id={run}"
        merged.repartition(max(1, min(len(touched), 4 * spark.sparkContext.defaultParallelism)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        done = spark.read.parquet(folder) if touched else merged
        found = done.groupBy("bucket").agg(F.count("*").alias("rows"), F.count_if(F.col("_merge") == "I").alias("inserted"), F.count_if(F.col("_merge") == "U").alias("updated"), F.count_if("_changed").alias("changed")).collect() if touched else []
        now_held = {b: (b, h.held_by, h.rows, h.layout, buckets) for b, h in before.items()} | {r.bucket: (r.bucket, run, r.rows, layouts[-1].number, buckets) for r in found}
        spark.createDataFrame(list(now_held.values()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/scan_run_id={run}")
        counts = {n: sum(r[n] for r in found) for n in ("inserted", "updated", "changed")}
        counts |= {"kept": sum(h.rows for h in before.values()) - counts["updated"], "errors": errors}
    except BaseException as broken:
        _append(spark, path, run, 1, "failed", now(), pack, trigger, None, f"{type(broken).__name__}: {broken}"[:NOTE])
        raise
    _append(spark, path, run, 1, COMPLETED[errors > 0], now(), pack, trigger, counts, None)
    return counts


def write_run(incoming: DataFrame, path: str, pack: str, trigger: str = "manual", errors: int = 0, key: str = "job_id", merge: Merge = merge_jobs, buckets: int = BUCKETS, layouts: Sequence[Layout] = FIRST) -> dict[str, int]:
    """SNK-07, SNK-09, STATE-04, STATE-06: merge a run into the store.

    Rows the run does not hold stay as they are; ``first_seen`` keeps the least
    value. Of rows that repeat a key any one may win: make keys unique first.
    Rows come in the newest layout. Returns and logs counts: inserted, updated,
    changed, kept, errors. A run that raises is logged as failed (its note cut
    at NOTE characters), and the store stays as it was. ``merge`` gives the rows
    of the touched buckets with _merge (I, U, K) and _changed.
    """
    return _run(incoming, path, pack, trigger, errors, key, merge, buckets, layouts, everything=False)


def migrate(spark: SparkSession, path: str, layouts: Sequence[Layout], key: str = "job_id") -> bool:
    """STATE-07: rewrite the store in the newest layout, as a run; False if it has it already."""
    held = [h for h in manifest(spark, path) if h.rows]
    if not held or all(h.layout == layouts[-1].number for h in held):
        return False
    rows = _read(spark, path, held, layouts).drop("bucket", "_merge", "_changed")
    same = lambda current, incoming, key: current.withColumns({"_merge": F.lit("K"), "_changed": F.lit(False)})
    _run(rows.limit(0), path, f"layout {layouts[-1].number}", "migrate", 0, key, same, BUCKETS, layouts, everything=True)
    return True
