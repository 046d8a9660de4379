"""The store of runs and the streamed states, filled from the driver's tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postforge.operators import runs
from postforge.plans import catalog
from postforge.plans import queries as Q
from postforge.session import checkpoint_dir, table
from postforge.streaming import actions

#: The second layout of the store: another name of the status, and an age.
LAYOUTS = (runs.Layout(1), runs.Layout(2, adds={"open": "status <> 'F'"}, rewrites={"status": "lower(status)"}, drops=("comment_length",)))


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def order_runs(spark: SparkSession, sf_dir: str) -> str:
    """A store of orders as jobs: all of them as of the first run; then every
    seventh with another hash or status; then, under a new layout, orders of
    another kind. Gives the store's path."""
    path = _folder(spark, "store")
    k = F.col("job_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("role_family"), F.lit("1").alias("content_hash"), F.lit(100).cast("long").alias("first_seen"), F.lit(3).alias("comment_length"))
    runs.write_run(rows.where(k % 9 > 0), path, "orders")
    seventh = rows.where(k % 7 == 0).withColumns({"content_hash": F.when(k % 14 == 0, "2").otherwise("1"), "first_seen": F.lit(200).cast("long")})
    runs.write_run(seventh, path, "orders", errors=1)
    newest = seventh.where(k % 21 == 0).withColumns({"status": F.lit("p"), "open": F.lit(True), "first_seen": F.lit(50).cast("long")}).drop("comment_length")
    runs.write_run(newest, path, "orders", layouts=LAYOUTS)
    return path


def q_store_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.jobs(spark, order_runs(spark, sf_dir), layouts=LAYOUTS)


def q_store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs(spark, order_runs(spark, sf_dir)).select("scan_run_id", "status", *[F.col(f"counts.{c}").alias(c) for c in ("inserted", "updated", "changed", "kept", "errors")])


def q_store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each order was seen, and how often it had changed."""
    return runs.snapshots(spark, order_runs(spark, sf_dir)).groupBy("job_id").agg(F.count("*").alias("seen"), F.count_if("changed").alias("changes"))


_RUNS = """a as (select o_orderkey k, o_orderstatus s, o_orderpriority f, o_orderkey % 9 > 0 r1, o_orderkey % 7 = 0 r2, o_orderkey % 21 = 0 r3 from orders)"""
catalog.register(
    "q_store_jobs",
    q_store_jobs,
    f"""with {_RUNS} select k job_id, case when r3 then 'p' else lower(s) end status, f role_family, case when k % 14 = 0 then '2' else '1' end content_hash,
  case when r3 then 50 when r1 then 100 else 200 end::bigint first_seen, r3 or s <> 'F' as open from a where r1 or r2""",
)
catalog.register(
    "q_store_log",
    q_store_log,
    f"""with {_RUNS}, n as (select count(*) filter (r1) n1, count(*) filter (r2) n2, count(*) filter (r2 and r1) u2, count(*) filter (r2 and r1 and k % 14 = 0) c2, count(*) filter (r3) n3, count(*) filter (r3 and lower(s) <> 'p') c3, count(*) filter (r1 or r2) every from a)
select 1::bigint scan_run_id, 'completed' status, n1 inserted, 0::bigint updated, 0::bigint changed, 0::bigint kept, 0::bigint errors from n
union all select 2, 'completed_with_errors', n2 - u2, u2, c2, n1 - u2, 1 from n union all select 3, 'completed', 0, n3, c3, every - n3, 0 from n""",
)
catalog.register(
    "q_store_snapshots",
    q_store_snapshots,
    f"""with {_RUNS} select k job_id, r1::bigint + r2::bigint + r3::bigint seen, (r2 and r1 and k % 14 = 0)::bigint + (r3 and lower(s) <> 'p')::bigint changes from a where r1 or r2""",
)


def q_stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log, written as files, streamed file by file into the store, read back as states."""
    path = _folder(spark, "actions")
    Q.action_log(spark, sf_dir).repartition(3, "job_id", "id").write.parquet(f"{path}/log")
    actions.stream_into(actions.read_log(spark, f"{path}/log", files=1), f"{path}/states", f"{path}/progress").awaitTermination()
    return actions.states(spark, f"{path}/states")


catalog.register("q_stream_states", q_stream_states, catalog.oracle_sql()["q_action_state"])
