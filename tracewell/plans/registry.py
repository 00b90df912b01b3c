"""All named queries and their SQL."""

from __future__ import annotations

from tracewell.plans import (
    audit_queries,
    evaluation_queries,
    lineage_queries,
    migration_queries,
    observability_queries,
    step_queries,
    stream_queries,
)

MODULES = [step_queries, audit_queries, observability_queries, lineage_queries, migration_queries, evaluation_queries, stream_queries]

QUERIES, ORACLES = {}, {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
