"""All queries of this subpackage by name, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from dialoom.llm import queries_personal, queries_quality, queries_residue, queries_rows, queries_subset, queries_text, queries_tokens

MODULES = (queries_rows, queries_text, queries_residue, queries_personal, queries_quality, queries_tokens, queries_subset)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
