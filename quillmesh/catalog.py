"""The registered queries of the core and the SQL each is checked against."""

from __future__ import annotations

from quillmesh.plans import audits, evaluations, graphs, identities, references, searches, services, sources, stores  # noqa: F401
from quillmesh.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
