"""Queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans import chatstore, corpus, costs, history, ingest, intervals, joins, ledgers, payloads, placement, reports, requests, rollouts, trees, usage, worktrees

MODULES = (usage, intervals, joins, placement, ledgers, requests, rollouts, costs, reports, corpus, payloads, history, worktrees, trees, chatstore, ingest)
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def _queries() -> dict:
    """All modules' queries; a name that two of them have is an error."""
    out: dict = {}
    for m in MODULES:
        if twice := out.keys() & m.QUERIES.keys():
            raise ValueError(f"{m.__name__} registers again: {sorted(twice)}")
        out |= m.QUERIES
    return out


QUERIES = _queries()
