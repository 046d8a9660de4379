"""Workflow state: fold of the action log, merge of runs, snapshots.

The fold is one shuffle of partial ``max_by`` aggregates: each field is the
value of the last row that touches it. Batch and stream share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.functions import fixed as K

_SAVED, _APPLIED = (", ".join(f"'{s}'" for s in states) for states in (K.SAVED_STATES, K.APPLIED_STATES))

#: field: (when a row touches it, the value it then has)
TOUCHES = {
    "application_status": ("action_type in ('saved', 'applied') or (action_type = 'application_status' and action_value is not null)", "case when action_type = 'application_status' then action_value else action_type end"),
    "saved": ("action_type = 'saved' or (action_type = 'application_status' and action_value is not null)", f"case when action_type = 'saved' then coalesce(action_value, 'true') in ('true', '1', 'yes') else action_value in ({_SAVED}) end"),
    "applied": ("action_type = 'applied' or (action_type = 'application_status' and action_value is not null)", f"case when action_type = 'applied' then coalesce(action_value, 'true') in ('true', '1', 'yes') else action_value in ({_APPLIED}) end"),
    "ignored": ("action_type = 'ignored' or (action_type = 'application_status' and action_value is not null)", "case when action_type = 'ignored' then coalesce(action_value, 'true') in ('true', '1', 'yes') else action_value = 'ignored' end"),
    "not_interested": ("action_type = 'not_interested' or (action_type = 'application_status' and action_value is not null)", "case when action_type = 'not_interested' then coalesce(action_value, 'true') in ('true', '1', 'yes') else action_value = 'not_interested' end"),
    "reviewed": ("action_type = 'reviewed'", "coalesce(action_value, 'true') in ('true', '1', 'yes')"),
    "notes": ("action_type = 'notes' or notes is not null", "coalesce(notes, action_value, '')"),
}

#: Action names as typed to action names as stored.
ALIASES = {"save": "saved", "ignore": "ignored", "mark_applied": "applied", "accept": "reviewed", "accepted": "reviewed", "mark_reviewed": "reviewed"}


def fold_aggregates() -> list:
    at = F.struct("created_at", "id")
    out = [F.max_by(F.expr(f"case when {t} then {v} end"), F.expr(f"case when {t} then struct(created_at, id) end")).alias(name) for name, (t, v) in TOUCHES.items()]
    return [*out, F.min("created_at").alias("created_at"), F.max_by("updated_at", at).alias("updated_at"), F.count("*").alias("n_actions")]


def fold_actions(log: DataFrame) -> DataFrame:
    """STATE-02: one row per job_id. Works on a static or streaming log."""
    return log.groupBy("job_id").agg(*fold_aggregates())


def effective_status(d=None) -> str:
    """PRJ-06."""
    return "case when coalesce(application_status, '') <> '' then application_status when applied then 'applied' when saved then 'saved' else '' end"


def new_actions(proposed: DataFrame, states: DataFrame) -> DataFrame:
    """STATE-03: proposed status rows that would change the state."""
    have = states.select("job_id", F.expr(effective_status()).alias("have"))
    return proposed.join(have, "job_id", "left").where(~F.col("action_value").eqNullSafe(F.col("have"))).drop("have")


def last_by_seq(rows: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """Q5: one row a key, the last by sequence."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(seq)).alias("r")).select("r.*")


def merge_runs(current: DataFrame, incoming: DataFrame, key: str = "job_id", watched=("content_hash", "status", "role_family")) -> DataFrame:
    """STATE-01: (all columns, first_seen kept, merge in I/U/K, changed). Rows
    absent from the run stay as they are. One full outer join by key."""
    old = current.select(*[F.col(c).alias(f"o_{c}") for c in current.columns])
    joined = incoming.join(old, incoming[key] == F.col(f"o_{key}"), "full_outer")
    is_new, is_kept = F.col(f"o_{key}").isNull(), F.col(key).isNull()
    changed = ~is_new & ~is_kept & ~F.expr(" and ".join(f"{c} <=> o_{c}" for c in watched))
    cols = [F.when(is_kept, F.col(f"o_{c}")).otherwise(F.least(F.col(c), F.col(f"o_{c}")) if c == "first_seen" else F.col(c)).alias(c) for c in incoming.columns]
    return joined.select(*cols, F.when(is_new, "I").when(is_kept, "K").otherwise("U").alias("merge"), changed.alias("changed"))
