"""The named queries of the engine and the DuckDB SQL that states each of them again."""

from __future__ import annotations

from plumbline.plans import arena, boundary, checks, claims, extraction, navigation, probes, runs, scoring, segments, sources, texts

_PLANS = (claims, segments, extraction, scoring, arena, navigation, probes, sources, checks, texts, runs, boundary)
QUERIES: dict = {name: run for plan in _PLANS for name, run in plan.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
