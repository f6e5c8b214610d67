"""All queries of the library by name, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from sigloom.plans import decisions, further, pauses, programme, renditions, rules, scoring, signal_work, signals, spans, streams

_MODULES = (signals, spans, scoring, rules, signal_work, further, programme, renditions, decisions, pauses, streams)
QUERIES: dict = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
