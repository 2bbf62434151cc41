"""Replay: current rows from event logs, and what-if projections of queue mutations."""

from __future__ import annotations

import inspect
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import backoff, retry_state
from .checks import TERMINAL


def fold_executions(events: DataFrame) -> DataFrame:
    """(execution_id, state, revision, events, first_at, last_at) from (execution_id, revision, to_state, created_at): by revision, never by arrival."""
    return events.groupBy("execution_id").agg(
        F.max_by("to_state", "revision").alias("state"), F.max("revision").alias("revision"), F.count("*").alias("events"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def reap(leases: DataFrame, now: Column, initial: float, multiplier: float, maximum: float, max_attempts: int) -> DataFrame:
    """What a reap of expired leases would do: next state and, for those that go back, when they are due."""
    gone = leases.where((F.col("state").isin("leased", "running")) & (F.col("lease_expires_at") <= now))
    state = retry_state(F.col("attempt"), F.lit(max_attempts))
    return gone.withColumn("next_state", state).withColumn("next_attempt_at", F.when(state == "queued", now + backoff("attempt", initial, multiplier, maximum)))


class Run:
    """One run's document while its operations are replayed; each method named as a kind says why it can't be applied, or applies it."""

    def __init__(self) -> None:
        self.state, self.tasks, self.waits, self.signals, self.watches = "running", {}, {}, {}, {}

    def document(self) -> dict:
        return {"tasks": self.tasks, "waits": self.waits, "signals": self.signals, "watches": self.watches}

    def last(self, task: str) -> dict:
        return self.tasks[task]["attempts"][-1]

    def _bad_needs(self, task: str, needs: list) -> str | None:
        if len(set(needs)) < len(needs) or task in needs:
            return "duplicate or self dependency"
        if not self.tasks.keys() >= set(needs):
            return "unknown dependency"
        todo, seen = list(needs), set()
        while todo:
            if (x := todo.pop()) == task:
                return "dependency cycle"
            if x not in seen:
                seen.add(x)
                todo += self.tasks[x]["dependencies"]
        return None

    def add_task(self, task_id: str, command=None, dependencies=()) -> str | None:
        if task_id in self.tasks:
            return "task exists"
        if why := self._bad_needs(task_id, list(dependencies)):
            return why
        self.tasks[task_id] = {"dependencies": list(dependencies), "attempts": [{"command": command, "state": "planned"}]}

    def set_dependencies(self, task_id: str, dependencies: list) -> str | None:
        if len(self.tasks[task_id]["attempts"]) > 1 or self.last(task_id)["state"] != "planned":
            return "dispatched before"
        if why := self._bad_needs(task_id, dependencies):
            return why
        self.tasks[task_id]["dependencies"] = dependencies

    def dispatch(self, task_id: str) -> str | None:
        if self.last(task_id)["state"] != "planned":
            return "not planned"
        if any(self.last(x)["state"] not in TERMINAL for x in self.tasks[task_id]["dependencies"]):
            return "dependencies have not settled"
        self.last(task_id)["state"] = "pending_dispatch"

    def new_attempt(self, task_id: str, command=None) -> str | None:
        if self.last(task_id)["state"] not in TERMINAL:
            return "current attempt is open"
        self.tasks[task_id]["attempts"].append({"command": command, "state": "planned"})

    def cancel(self, task_id: str, reason: str) -> None:
        """A planned attempt ends here; an open one keeps its state until its result says what became of it."""
        if self.last(task_id)["state"] == "planned":
            self.last(task_id).update(state="cancelled", reason=reason)
        elif self.last(task_id)["state"] not in TERMINAL:
            self.last(task_id)["cancel_requested"] = reason

    def wait(self, wait_id: str, payload=None) -> str | None:
        if wait_id in self.waits:
            return "wait exists"
        self.waits[wait_id] = {"state": "open", "payload": payload}

    def release_wait(self, wait_id: str) -> str | None:
        if self.waits.get(wait_id, {}).get("state") != "open":
            return "wait is not open"
        self.waits[wait_id]["state"] = "released"

    def signal(self, signal_id: str, payload) -> str | None:
        if signal_id in self.signals:
            return "signal exists"
        self.signals[signal_id] = payload

    def watch_task(self, task_id: str, watch_id: str, target, max_deliveries: int | None = None) -> str | None:
        if watch_id in self.watches:
            return "watch exists"
        self.watches[watch_id] = {"task_id": task_id, "attempt": len(self.tasks[task_id]["attempts"]) - 1, "target": target, "max_deliveries": max_deliveries}

    def finish(self, state: str) -> str | None:
        if state not in ("succeeded", "failed", "cancelled"):
            return "no terminal state"
        if any(t["attempts"][-1]["state"] not in TERMINAL for t in self.tasks.values()):
            return "open tasks"
        if any(w["state"] == "open" for w in self.waits.values()):
            return "open waits"
        self.state = state

    def result(self, task_id: str, state: str) -> str | None:
        """No operation: what the execution log says of the task's current attempt."""
        if self.last(task_id)["state"] in TERMINAL or state not in TERMINAL:
            return "no open attempt or no terminal state"
        self.last(task_id)["state"] = state


OPERATIONS = ("add_task", "set_dependencies", "dispatch", "new_attempt", "cancel", "wait", "signal", "release_wait", "finish", "watch_task")


def replay_operations(operations: DataFrame) -> DataFrame:
    """Run documents from (run_id, revision, kind, data): (run_id, revision, state, document as JSON, rejected).

    Kinds are OPERATIONS, and result, a row of the execution log among them.  What can't be applied, since
    its kind, fields or what it names are unknown, the run is over, or a guard forbids it, leaves the
    document as it is and is listed as (revision, reason).  A run is replayed in one group, in order
    of revision: each operation depends on all before it.
    """

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        run, rejected = Run(), []
        for revision, kind, data in pdf.sort_values("revision")[["revision", "kind", "data"]].itertuples(index=False):
            fields = json.loads(data) if data else {}
            if run.state != "running" and kind != "result":
                why = "run is over"
            elif kind not in (*OPERATIONS, "result"):
                why = "unknown kind"
            elif kind != "add_task" and "task_id" in fields and fields["task_id"] not in run.tasks:
                why = "unknown task"
            else:
                try:
                    inspect.signature(getattr(run, kind)).bind(**fields)
                    why = getattr(run, kind)(**fields)
                except TypeError:
                    why = "wrong fields"
            if why:
                rejected.append({"revision": int(revision), "reason": why})
        body = json.dumps(run.document(), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return pd.DataFrame({"run_id": [pdf.run_id.iloc[0]], "revision": [int(pdf.revision.max())], "state": [run.state], "document": [body], "rejected": [rejected]})

    return operations.groupBy("run_id").applyInPandas(replay, "run_id string, revision long, state string, document string, rejected array<struct<revision:long,reason:string>>")


def terminal_mismatch(executions: DataFrame, outbox: DataFrame, terminal: list[str]) -> DataFrame:
    """(execution_id, problem): terminal exactly if it has a result and an outbox row."""
    o = outbox.groupBy("execution_id").agg(F.count("*").alias("_n"))
    e = executions.select("execution_id", "state", "result_json").join(o, "execution_id", "full")
    done = F.coalesce(F.col("state").isin(terminal), F.lit(False))
    problem = (
        F.when(F.col("state").isNull(), "outbox row without execution")
        .when(done & F.col("result_json").isNull(), "terminal without result")
        .when(~done & F.col("result_json").isNotNull(), "result before the end")
        .when(done & F.col("_n").isNull(), "terminal without outbox row")
        .when(~done & F.col("_n").isNotNull(), "outbox row before the end")
    )
    return e.select("execution_id", problem.alias("problem")).where("problem IS NOT NULL")


def open_effects(effect_events: DataFrame, open_states: list[str]) -> DataFrame:
    """Effects whose last event leaves them open."""
    last = effect_events.groupBy("effect_id").agg(F.max_by(F.struct("execution_id", "to_state"), "revision").alias("x"))
    return last.select("effect_id", "x.execution_id", F.col("x.to_state").alias("state")).where(F.col("state").isin(open_states))
