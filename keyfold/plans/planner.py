"""Which runs to compact next: pure functions of the run list."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from keyfold.plans.schema import RunMeta

L0_TRIGGER = 4
STALL_TRIGGER = 12
FANOUT = 4


@dataclass(frozen=True)
class Job:
    """Inputs that become runs of the target level; deletes can go if nothing lies below."""

    target: int
    inputs: tuple[RunMeta, ...]
    drop_tombstones: bool


def budget(level: int) -> int:
    """The most runs of a level before it is compacted: 4 in level 1 and four times as many in each further one."""
    return FANOUT**level


def at_level(runs: Iterable[RunMeta], level: int) -> list[RunMeta]:
    return [r for r in runs if r.level == level]


def deepest(runs: Iterable[RunMeta]) -> int:
    """The deepest level with runs; -1 without any."""
    return max((r.level for r in runs), default=-1)


def plan(runs: Iterable[RunMeta], force: bool = False) -> Job | None:
    """The next job: level 0 once it has enough runs (any, if forced), else the shallowest level over its budget.

    Level 0 goes down as a whole, a deeper level by as many runs as it is over its budget,
    those with the least first keys, in one job. All runs of the target within the range
    of the inputs join in, so the files of the target stay disjoint.
    """
    runs = list(runs)
    level0 = at_level(runs, 0)
    if len({r.seq for r in level0}) >= L0_TRIGGER or force and level0:
        source, picked = 0, level0
    else:
        over = [n for n in range(1, deepest(runs) + 1) if len(at_level(runs, n)) > budget(n)]
        if not over:
            return None
        source = over[0]
        level = sorted(at_level(runs, source), key=lambda r: r.first_key)
        picked = level[: len(level) - budget(source)]
    target = source + 1
    first, last = min(r.first_key for r in picked), max(r.last_key for r in picked)
    inputs = (*picked, *(r for r in at_level(runs, target) if r.overlaps(first, last)))
    return Job(target, inputs, drop_tombstones=deepest(runs) <= target)
