"""Queries of this subpackage: name → (function of session and directory, SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from cellweave.llm import queries

QUERIES: dict = {**queries.QUERIES, "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}
