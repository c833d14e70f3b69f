"""The run log: an append-only table of status changes ``(task_id, at, status, comment)``."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.errors import NotFound
from sparkmart.functions.types import row_type
from sparkmart.operators.paging import in_range, paginate
from sparkmart.session import local_frame
from sparkmart.store import TableStore

# The states a run can be in.
IN_PROGRESS, FAILED, COMPLETED = "In progress", "Execution error", "Completed"
STATUSES = (IN_PROGRESS, FAILED, COMPLETED)

LOG = row_type(task_id=T.StringType(), at=T.TimestampType(), status=T.StringType(), comment=T.StringType())


def current_tasks(log: DataFrame, order: str = "at") -> DataFrame:
    """``(task_id, create_at, status, comment)`` of every task: its first entry's time, its last state.

    Both are aggregates that combine on the map side, whatever the length of a task's history.
    """
    last = F.max_by(F.struct("status", "comment"), order)
    return (
        log.groupBy("task_id")
        .agg(F.min("at").alias("create_at"), last.alias("last"))
        .select("task_id", "create_at", "last.status", "last.comment")
    )


def list_tasks(log: DataFrame, start=None, end=None, page: int = 1, size: int = 10, order: str = "at") -> DataFrame:
    """One page of the tasks created in an inclusive time range, newest first."""
    tasks = in_range(current_tasks(log, order), "create_at", start, end)
    return paginate(tasks, ["create_at", "task_id"], page, size, descending=True)


class RunLog:
    """The run log kept in a table store."""

    TABLE = "run_log"

    def __init__(self, store: TableStore):
        self.store = store
        store.create(self.TABLE, LOG)

    def frame(self) -> DataFrame:
        return self.store.read(self.TABLE)

    def _write(self, task_id: str, status: str, comment: str | None) -> None:
        if not task_id:
            raise ValueError("a task needs an id")
        if status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        now = datetime.datetime.now(datetime.timezone.utc)
        self.store.append_small(self.TABLE, local_frame(self.store.spark, [(task_id, now, status, comment)], LOG))

    def create(self, status: str = IN_PROGRESS, task_id: str | None = None) -> str:
        task_id = task_id if task_id is not None else str(uuid.uuid4())
        self._write(task_id, status, None)
        return task_id

    def change(self, task_id: str, status: str, comment: str | None = None) -> None:
        self._write(task_id, status, comment)

    def get(self, task_id: str):
        row = current_tasks(self.frame().where(F.col("task_id") == task_id)).first()
        if row is None:
            raise NotFound(f"no task {task_id}")
        return row
