"""The bucketed store: what a run rewrites, layouts, replayed batches, actions on jobs."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from postforge.operators import runs, state
from postforge.streaming import actions

KIND = "job_id string, status string, content_hash string, role_family string, first_seen long"


def made(spark, ids, **kw):
    row = {"status": "open", "content_hash": "1", "role_family": "x", "first_seen": 5} | kw
    return spark.createDataFrame([(i, *row.values()) for i in ids], KIND)


def files(path, run):
    folder = f"{path}/rows/scan_run_id={run}"
    return {d for d in os.listdir(folder) if d.startswith("bucket=")} if os.path.isdir(folder) else set()


def test_a_run_rewrites_the_buckets_it_touches_once(spark, tmp_path):
    path = str(tmp_path)
    runs.write_run(made(spark, [f"j{i}" for i in range(2000)]), path, "p", buckets=100)
    assert len(files(path, 1)) == 100
    got = runs.write_run(made(spark, [f"j{i}" for i in range(0, 2000, 100)], content_hash="2"), path, "p")  # one in a hundred
    assert got == {"inserted": 0, "updated": 20, "changed": 20, "kept": 1980, "errors": 0}
    assert 0 < len(files(path, 2)) <= 20
    assert sorted(os.listdir(path)) == ["manifest", "rows", "runs"]
    found = runs.jobs(spark, path)
    assert found.count() == 2000 and found.where("content_hash = '2'").count() == 20
    assert runs.jobs(spark, path, run=1).where("content_hash = '2'").count() == 0
    assert len(found.inputFiles()) >= 100 and {m.buckets for m in runs.manifest(spark, path)} == {100}


@pytest.mark.parametrize("field", runs.WATCHED)
def test_each_watched_field_makes_a_change(spark, field):
    kind = "job_id string, " + ", ".join(f"{c} string" for c in runs.WATCHED) + ", title string"
    old = spark.createDataFrame([("a", *["1"] * 6, "t"), ("b", *["1"] * 6, "t"), ("c", *[None] * 6, "t")], kind)
    new = old.withColumns({field: F.when(F.col("job_id") == "a", "2").otherwise(F.col(field)), "title": F.lit("another")})
    assert {r.job_id: r._changed for r in runs.merge_jobs(old, new, "job_id").collect()} == {"a": True, "b": False, "c": False}


def test_an_empty_run_and_a_lone_row(spark, tmp_path):
    path = str(tmp_path)
    assert runs.write_run(made(spark, []), path, "p") == {"inserted": 0, "updated": 0, "changed": 0, "kept": 0, "errors": 0}
    assert runs.jobs(spark, path) is None
    runs.write_run(made(spark, ["a", None]), path, "p")
    assert runs.write_run(made(spark, []), path, "p")["kept"] == 2
    assert runs.jobs(spark, path).count() == 2 and runs.snapshots(spark, path).count() == 2


LAYOUTS = (runs.Layout(1), runs.Layout(2, adds={"year": "2000 + first_seen"}, rewrites={"status": "upper(status)"}), runs.Layout(3, adds={"note": "concat(status, year)"}, drops=("role_family",)))


def test_older_layouts_are_read_migrated_and_merged(spark, tmp_path):
    path = str(tmp_path)
    runs.write_run(made(spark, [f"j{i}" for i in range(40)]), path, "p", buckets=8)
    second = spark.createDataFrame([("j1", "SHUT", "1", "x", 7, 2030)], KIND + ", year long")
    assert runs.write_run(second, path, "p", layouts=LAYOUTS[:2]) == {"inserted": 0, "updated": 1, "changed": 1, "kept": 39, "errors": 0}
    read = lambda: {r.job_id: (r.status, r.year, r.note) for r in runs.jobs(spark, path, layouts=LAYOUTS).collect()}
    before = read()
    assert before["j0"] == ("OPEN", 2005, "OPEN2005") and before["j1"] == ("SHUT", 2030, "SHUT2030") and len(before) == 40
    with pytest.raises(ValueError, match="layout 2"):
        runs.jobs(spark, path)
    assert runs.migrate(spark, path, LAYOUTS) and not runs.migrate(spark, path, LAYOUTS)
    assert read() == before and {m.layout for m in runs.manifest(spark, path)} == {3}
    assert "role_family" not in runs.jobs(spark, path, layouts=LAYOUTS).columns
    third = spark.createDataFrame([("j2", "OPEN", "9", 1, 2001, "n"), ("k", "OPEN", "9", 1, 2001, "n")], "job_id string, status string, content_hash string, first_seen long, year long, note string")
    assert runs.write_run(third, path, "p", layouts=LAYOUTS) == {"inserted": 1, "updated": 1, "changed": 1, "kept": 39, "errors": 0}
    assert read()["j2"] == ("OPEN", 2001, "n") and runs.jobs(spark, path, run=1).count() == 40


def log(spark, n=60):
    kinds = ("saved", "applied", "application_status", "notes", "ignored", "reviewed")
    at = lambda i: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=i // 3)
    rows = [(i, f"j{i * 7 % 9}", kinds[i % 6], (None, "true", "interviewing", "false")[i % 4], f"n{i}" if i % 5 == 0 else None, at(i), at(i)) for i in range(n)]
    return spark.createDataFrame(rows, actions.LOG_SCHEMA)


def plain(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def test_batches_in_any_order_and_repeated_give_the_fold(spark, tmp_path):
    path, whole = str(tmp_path), log(spark)
    batches = [whole.where(F.col("id") % 4 == i) for i in (2, 0, 3, 1)]
    for i, batch in enumerate(batches):
        assert actions.fold_batch(batch, path, f"b{i}")
        assert not actions.fold_batch(batch, path, f"b{i}")  # replayed: nothing changes
    assert plain(actions.states(spark, path)) == plain(state.fold_actions(whole))


def test_stream_restarts_where_it_was(spark, tmp_path):
    path, whole = str(tmp_path), log(spark)
    for i in (0, 1):
        whole.where(F.col("id") % 2 == i).coalesce(1).write.mode("append").parquet(f"{path}/log")
        actions.stream_into(actions.read_log(spark, f"{path}/log", files=1), f"{path}/states", f"{path}/progress").awaitTermination()
    assert plain(actions.states(spark, f"{path}/states")) == plain(state.fold_actions(whole))
    assert {r.trigger for r in runs.runs(spark, f"{path}/states").collect()} == {"actions:0", "actions:1"}


def test_an_action_gives_the_fresh_record_or_an_error(spark, tmp_path):
    path, jobs = str(tmp_path), spark.createDataFrame([("a", "Trader"), ("b", "Quant")], "job_id string, title string")
    got = actions.record_action(jobs, path, "a", "mark_applied")
    assert (got["title"], got["applied"], got["application_status"], got["saved"]) == ("Trader", True, "applied", None)
    got = actions.record_action(jobs, path, "a", "application_status", "saved", notes="call back")
    assert (got["applied"], got["saved"], got["action_notes"], got["n_actions"]) == (False, True, "call back", 2)
    with pytest.raises(actions.UnknownJob):
        actions.record_action(jobs, path, "c", "save")
    assert actions.states(spark, path).count() == 1
