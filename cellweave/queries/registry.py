"""All registered queries: name → (function of session and directory, SQL or None)."""

from __future__ import annotations

from cellweave.queries import cluster_q, invariant_q, io_q, profile_q, quality_q, stats_q

QUERIES: dict = {}
for _module in (quality_q, stats_q, cluster_q, profile_q, io_q, invariant_q):
    for _name in _module.QUERIES:
        if _name in QUERIES:
            raise ValueError(f"query {_name} registered twice")
    QUERIES.update(_module.QUERIES)
