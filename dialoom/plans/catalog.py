"""All queries of the library proper, by name, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from dialoom.plans import dialogue_queries, matching_queries, nested_queries, payload_queries, program_queries, propagation_queries, selection_queries, streaming_queries

MODULES = (nested_queries, propagation_queries, dialogue_queries, selection_queries, matching_queries, payload_queries, streaming_queries, program_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
