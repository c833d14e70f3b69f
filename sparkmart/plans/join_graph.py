"""Order the join rules of a mart.

Which join runs how, and with which build side, is left to Catalyst and AQE.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from sparkmart.errors import SpecError
from sparkmart.plans.spec import Endpoint, JoinRule, MartSpec, TableKey

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class JoinStep:
    """Attach ``table`` on pairs of (endpoint already joined, endpoint of the new table)."""

    table: TableKey
    pairs: tuple[tuple[Endpoint, Endpoint], ...]


@dataclass(frozen=True)
class JoinPlan:
    root: TableKey
    steps: tuple[JoinStep, ...]

    @property
    def tables(self) -> set[TableKey]:
        return {self.root, *(s.table for s in self.steps)}


Pairs = tuple[tuple[Endpoint, Endpoint], ...]


def hang_from(plan: JoinPlan, root: TableKey) -> dict[TableKey, list[tuple[TableKey, Pairs]]] | None:
    """The join tree hung up at any of its tables: table → joined tables below it with their key pairs.

    None when a step ties its table to several others, so that the joins are no tree of table pairs.
    """
    links: dict[TableKey, list[tuple[TableKey, Pairs]]] = {t: [] for t in plan.tables}
    for step in plan.steps:
        known = {a.table for a, _ in step.pairs}
        if len(known) > 1:
            return None
        other = known.pop()
        links[other].append((step.table, step.pairs))
        links[step.table].append((other, tuple((b, a) for a, b in step.pairs)))
    below: dict[TableKey, list[tuple[TableKey, Pairs]]] = {}
    todo: list[tuple[TableKey, TableKey | None]] = [(root, None)]
    while todo:
        table, above = todo.pop()
        below[table] = [link for link in links[table] if link[0] != above]
        todo += [(t, table) for t, _ in below[table]]
    return below


def _root(spec: MartSpec) -> TableKey:
    """The first left table that no rule has on its right, else the left table of rule one."""
    rights = {r.right.table for r in spec.joins}
    return next((r.left.table for r in spec.joins if r.left.table not in rights), spec.joins[0].left.table)


def _split(rule: JoinRule, placed: set[TableKey]) -> tuple[Endpoint, Endpoint] | None:
    """(known side, new side) when exactly one side is already placed."""
    sides = [e for e in (rule.left, rule.right) if e.table in placed]
    if len(sides) != 1:
        return None
    known = sides[0]
    return known, rule.right if known is rule.left else rule.left


def plan_joins(spec: MartSpec, strict: bool = False, composite: bool = False) -> JoinPlan:
    """Check the join graph and lay it out.

    ``strict`` refuses several tables without a rule. ``composite`` accepts rules whose two tables are
    both placed already (a second key pair, or a cycle) and adds them to the join condition.
    """
    present = {t.key for t in spec.tables}
    if not present:
        raise SpecError(f"mart {spec.name} selects no table")
    for rule in spec.joins:
        for end in (rule.left, rule.right):
            if end.table not in present:
                raise SpecError(f"join endpoint {end.table} is not part of mart {spec.name}")

    if not spec.joins:
        if strict and len(spec.tables) > 1:
            raise SpecError(f"mart {spec.name} has several tables but no join rule")
        plan = JoinPlan(spec.tables[0].key, ())
    else:
        root = _root(spec)
        placed, waiting, steps = {root}, list(spec.joins), []
        while waiting:
            hit = next(((r, s) for r in waiting if (s := _split(r, placed))), None)
            if hit is None:
                raise SpecError(f"join rules of mart {spec.name} do not form one tree")
            rule, (known, new) = hit
            waiting.remove(rule)
            placed.add(new.table)
            pairs = [(known, new)]
            if composite:
                for other in [r for r in waiting if {r.left.table, r.right.table} <= placed]:
                    here = other.right if other.right.table == new.table else other.left
                    there = other.left if here is other.right else other.right
                    pairs.append((there, here))
                    waiting.remove(other)
            steps.append(JoinStep(new.table, tuple(pairs)))
        plan = JoinPlan(root, tuple(steps))

    left_out = [str(t.key) for t in spec.tables if t.key not in plan.tables]
    if left_out:
        log.warning("mart %s leaves out tables without a join rule: %s", spec.name, ", ".join(left_out))
    return plan
