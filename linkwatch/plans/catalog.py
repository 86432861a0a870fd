"""Registry of named queries: a Spark builder and, where SQL can express it,
an equivalent DuckDB SQL text over the driver's tables (the oracle).

Every query reads the driver's ``events`` table mapped onto the probe fact
layout (``pm``) and runs over the whole table unless a look-back window is
the feature being exercised.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from linkwatch import schema as S


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, (fn.__doc__ or "").strip())
        return fn

    return deco


def _host_case() -> str:
    whens = " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(S.DEFAULT_HOSTS))
    return f"CASE user_id % {len(S.DEFAULT_HOSTS)} {whens} END"


# DuckDB form of ``pm_from_events``.
PM_CTE = f"""pm AS (
  SELECT event_id AS id,
         ts AS "timestamp",
         {_host_case()} AS target_host,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS response_time_ms,
         (event_type = 'error') AS packet_loss,
         CASE WHEN event_type = 'error' THEN '{S.LOSS_MESSAGE}' END AS error_message,
         ts AS created_at
  FROM events
)"""

AS_OF_SQL = f"TIMESTAMP '{S.FIXTURE_AS_OF.isoformat(sep=' ')}'"


def with_pm(body: str) -> str:
    """Prefix a query body with the fact-table CTE (``body`` may add CTEs)."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {PM_CTE},\n{body[5:]}"
    return f"WITH {PM_CTE}\n{body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: v.build for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v.sql for k, v in REGISTRY.items() if v.sql}


def _load_all() -> None:
    # Importing the modules registers their queries.
    from linkwatch.plans import queries_core  # noqa: F401
    from linkwatch.plans import queries_stream  # noqa: F401
    from linkwatch.plans import queries_table  # noqa: F401
