"""The registered queries of the change-log engine and their SQL."""

from __future__ import annotations

from .plans import control, delivery, replication, snapshot, state


def queries() -> dict:
    return state.plans.queries | snapshot.plans.queries | delivery.plans.queries | replication.plans.queries | control.plans.queries


def oracle_sql() -> dict[str, str]:
    return state.plans.sql | snapshot.plans.sql | delivery.plans.sql | replication.plans.sql | control.plans.sql
