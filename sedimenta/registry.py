"""Registered queries of the engine's own operators: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from .functions import html, urls
from .operators import caches, chunking, corpus, extraction, retrieval, signals
from .operators import cue_tables, dom, evaluation, flows, indexing, knowledge, near_duplicates, refine_fold, refinement, scoring, search, standing_index, structure, webtext
from .sources import artifact_files, artifacts, stores
from .streaming import dedup

FLAGSHIP = "u01_normalize_url"
MODULES = (urls, html, corpus, signals, retrieval, caches, extraction, chunking, dedup, structure, dom, artifacts, refinement, refine_fold, evaluation, scoring, indexing, search, knowledge, webtext, stores, flows, near_duplicates, cue_tables, standing_index, artifact_files)


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
