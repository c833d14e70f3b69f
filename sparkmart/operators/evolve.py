"""Apply drift decisions and rename suggestions to marts, specs and the drift tables."""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.errors import NotFound
from sparkmart.functions.types import row_type
from sparkmart.operators import drift
from sparkmart.operators.paging import match_all, ordered_page
from sparkmart.operators.registry import Registry
from sparkmart.plans.spec import MartSpec, TableKey, remove_columns, rename_column, unique_names
from sparkmart.store import TableStore

SUGGESTIONS = row_type(
    id=T.LongType(),
    view_id=T.LongType(),
    db=T.StringType(),
    schema=T.StringType(),
    table=T.StringType(),
    old_column_name=T.StringType(),
    new_column_name=T.StringType(),
    strategy=T.StringType(),
    task_number=T.StringType(),
    created_at=T.TimestampType(),
)


@dataclass(frozen=True)
class Resolution:
    """A user's decisions on a mismatch group."""

    renames: tuple[tuple[str, str], ...] = ()
    deletes: tuple[str, ...] = ()
    drops: tuple[str, ...] = ()
    ignores: tuple[str, ...] = ()

    @staticmethod
    def from_dict(raw: Mapping) -> Resolution:
        return Resolution(
            tuple((r["old_name"], r["new_name"]) for r in raw.get("renames") or ()),
            tuple(raw.get("deletes") or ()),
            tuple(raw.get("drop_in_dwh") or ()),
            tuple(raw.get("ignores") or ()),
        )


@dataclass(frozen=True)
class Change:
    """What a resolution means: mart renames and drops, and the new spec."""

    spec: MartSpec
    renames: dict[str, str] = field(default_factory=dict)
    drops: tuple[str, ...] = ()
    spec_changed: bool = False


def _aliased(spec: MartSpec, key: TableKey, name: str) -> bool:
    """Whether the mart knows the source column by another name."""
    return any(
        c.name.lower() == name.lower() and c.alias and c.alias.lower() != name.lower()
        for t in spec.tables
        if t.key == key
        for c in t.columns
    )


def plan_resolution(spec: MartSpec, key: TableKey, resolution: Resolution) -> Change:
    """Work out a resolution before anything is written.

    Renames come first, then drops; deleted and dropped columns leave the spec. Ignored findings change
    nothing. An aliased column keeps its mart name when its source column is renamed.
    """
    start, renames = spec, {}
    for old, new in resolution.renames:
        if not _aliased(spec, key, old):
            renames[old] = new
        spec = rename_column(spec, key, old, new)
    drops = unique_names(resolution.drops)
    spec, _ = remove_columns(spec, key, unique_names([*resolution.deletes, *drops]))
    return Change(spec, renames, tuple(drops), spec != start)


def project_change(mart: DataFrame, change: Change) -> DataFrame:
    """The mart after a resolution, as one projection."""
    for old in change.renames:
        if old not in mart.columns:
            raise NotFound(f"the mart has no column {old}")
    names = [(c, change.renames.get(c, c)) for c in mart.columns]
    return mart.select(*(F.col(f"`{c}`").alias(n) for c, n in names if n not in change.drops))


def new_suggestions(report: DataFrame, pending: DataFrame, strategy: str = "heuristic") -> DataFrame:
    """The rename findings of a report that are not suggested yet."""
    found = report.where(F.col("type") == drift.RENAME).select(
        drift.content_id("view_id", "db", "schema", "table", "old", "new").alias("id"),
        "view_id",
        "db",
        "schema",
        "table",
        F.col("old").alias("old_column_name"),
        F.col("new").alias("new_column_name"),
        F.lit(strategy).alias("strategy"),
        F.lit(None).cast("string").alias("task_number"),
        F.current_timestamp().alias("created_at"),
    )
    return found.join(pending.select("id"), "id", "left_anti")


class Evolution:
    """Mismatch groups and rename suggestions kept in a table store."""

    GROUPS, ITEMS, SUGGESTIONS = "mismatch_groups", "mismatch_items", "rename_suggestions"

    def __init__(self, store: TableStore, registry: Registry):
        self.store, self.registry = store, registry
        store.create(self.GROUPS, drift.GROUPS)
        store.create(self.ITEMS, drift.ITEMS)
        store.create(self.SUGGESTIONS, SUGGESTIONS)

    # -- mismatch groups ------------------------------------------------------------------------

    def groups(self) -> DataFrame:
        return self.store.read(self.GROUPS)

    def items(self) -> DataFrame:
        return self.store.read(self.ITEMS)

    def record(self, report: DataFrame) -> None:
        """Open or refresh the groups of a drift report; a report without findings writes nothing.

        The report is read several times: settle it first.
        """
        if report.isEmpty():
            return
        now = F.lit(datetime.datetime.now(datetime.timezone.utc))
        groups, items = drift.upsert_groups(report, self.groups(), self.items(), now)
        # Items go first: an item without its group is never shown, a group without items would be.
        self.store.publish(self.ITEMS, items)
        self.store.publish(self.GROUPS, groups)

    def state(self) -> tuple[int, ...]:
        """Version numbers of the drift tables, to tell whether anything changed."""
        return tuple(self.store.version(t).number for t in (self.GROUPS, self.ITEMS, self.SUGGESTIONS))

    def list_groups(self, limit=None, offset=None, **filters) -> DataFrame:
        """Groups matching the given columns, newest first; ``status="all"`` means any."""
        if filters.get("status") == "all":
            filters["status"] = None
        return ordered_page(match_all(self.groups(), filters), ["created_at", "id"], limit, offset)

    def group(self, group_id: int):
        """A group with its items."""
        one = self.groups().where(F.col("id") == group_id)
        row = drift.groups_with_items(one, self.items().where(F.col("group_id") == group_id)).first()
        if row is None:
            raise NotFound(f"no mismatch group {group_id}")
        return row

    def _change(self, view_id: int, key: TableKey, resolution: Resolution) -> None:
        """Bring mart and spec to where a resolution leads, from wherever an earlier attempt has stopped.

        The mart comes first. What is already so is skipped: a mart column that has its new name or is gone, and
        a spec that no longer has the old name.
        """
        spec = self.registry.get(view_id)
        known = {c.name.lower() for t in spec.tables if t.key == key for c in t.columns}
        open_renames = tuple(r for r in resolution.renames if r[0].lower() in known or r[1].lower() not in known)
        change = plan_resolution(spec, key, replace(resolution, renames=open_renames))
        names = set(self.store.version(spec.name).names)
        renames = {old: new for old, new in change.renames.items() if old in names or new not in names}
        drops = [d for d in change.drops if d in names]
        if renames or drops:
            self.store.alter(spec.name, renames, drops)
        if change.spec_changed:
            self.registry.update(view_id, change.spec)

    def apply(self, group_id: int, resolution: Resolution) -> None:
        """Apply a resolution to mart and spec, then close the group. After a failure it can be applied again."""
        group = self.group(group_id)
        key = TableKey(group["database_name"], group["schema_name"], group["table_name"])
        self._change(group["schema_id"], key, resolution)
        self.store.publish(self.GROUPS, drift.resolve_group(self.groups(), group_id, F.current_timestamp()))

    # -- rename suggestions ---------------------------------------------------------------------

    def suggestions(self) -> DataFrame:
        return self.store.read(self.SUGGESTIONS)

    def suggest(self, report: DataFrame, strategy: str = "heuristic") -> None:
        """Turn the rename findings of a report into pending suggestions, once each."""
        fresh = new_suggestions(report, self.suggestions(), strategy)
        if not fresh.isEmpty():
            self.store.append_small(self.SUGGESTIONS, fresh)

    def list_suggestions(self, limit=None, offset=None, newest_first: bool = True, **filters) -> DataFrame:
        kept = match_all(self.suggestions(), filters)
        return ordered_page(kept, ["created_at", "id"], limit, offset, descending=newest_first)

    def _suggestion(self, suggestion_id: int):
        row = self.suggestions().where(F.col("id") == suggestion_id).first()
        if row is None:
            raise NotFound(f"no rename suggestion {suggestion_id}")
        return row

    def accept(self, suggestion_id: int) -> None:
        """Rename in mart and spec, then drop the suggestion. After a failure it can be accepted again."""
        s = self._suggestion(suggestion_id)
        key = TableKey(s["db"], s["schema"], s["table"])
        self._change(s["view_id"], key, Resolution(renames=((s["old_column_name"], s["new_column_name"]),)))
        self.reject(suggestion_id)

    def reject(self, suggestion_id: int) -> None:
        self._suggestion(suggestion_id)
        self.store.publish(self.SUGGESTIONS, self.suggestions().where(F.col("id") != suggestion_id))
