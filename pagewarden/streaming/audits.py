"""Streaming forms: running scores, alerts, and the re-audit state machine.  An extension of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audits import ALERT_DROP
from ..operators.scoring import PENALTY, SEVERITY, case

#: States of a re-audit: tasks open, being audited again, done, tasks opened again.
AWAITING, PASSED, MORE = "awaiting_fixes", "passed", "needs_more_work"


def running_scores(findings: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, site_id, score, findings) of a stream of findings(ts, site_id, severity, status)."""
    w = case(F.col("severity"), SEVERITY, 2)
    lost = w * case(F.col("status"), PENALTY, 0.0)
    rated = findings.where("status <> 'info'").withWatermark("ts", late).groupBy(F.window("ts", window), "site_id")
    return rated.agg(F.floor((1 - F.sum(lost) / F.sum(w)) * 100 + 0.5).alias("score"), F.count(F.lit(1)).alias("findings"))


def score_alerts(audits: DataFrame) -> DataFrame:
    """(site_id, audit_id, prev_score, score) where a stream of audits(site_id, audit_id, created_at, overall) drops by more than three points."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["created_at", "audit_id"])
        prev = state.get[0] if state.exists else None
        out = []
        for r in rows.itertuples():
            if prev is not None and r.overall < prev - ALERT_DROP:
                out.append((key[0], r.audit_id, prev, r.overall))
            prev = int(r.overall)
        state.update((prev,))
        yield pd.DataFrame(out, columns=["site_id", "audit_id", "prev_score", "score"])

    return audits.groupBy("site_id").applyInPandasWithState(step, "site_id long, audit_id long, prev_score int, score int", "prev int", "append", GroupStateTimeout.NoTimeout)


def reaudit_states(events: DataFrame) -> DataFrame:
    """(parent_id, old_state, new_state) of a stream of events(parent_id, ts, kind, done, total, broken).

    The events of a micro-batch are taken by their time, of one time tasks before audits.  kind ``tasks`` reports how many of a parent's tasks are done; ``audit`` reports, after all are, how
    many are still broken.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, ready = state.get if state.exists else (AWAITING, False)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "kind"], ascending=[True, False]).itertuples():
            old = now
            if r.kind == "tasks":
                ready = r.total > 0 and r.done == r.total
            elif ready and now != PASSED:
                now, ready = (MORE if r.broken > 0 else PASSED), False
            if now != old:
                out.append((key[0], old, now))
        state.update((now, ready))
        yield pd.DataFrame(out, columns=["parent_id", "old_state", "new_state"])

    return events.groupBy("parent_id").applyInPandasWithState(step, "parent_id long, old_state string, new_state string", "now string, ready boolean", "append", GroupStateTimeout.NoTimeout)
