"""All registered queries over the shared tables, with the SQL that states each of them a second time."""

from __future__ import annotations

from collections.abc import Callable

from lumentrace.plans import q_metrics, q_pipeline, q_relational, q_runs, q_text

MODULES = (q_metrics, q_relational, q_text, q_pipeline, q_runs)
QUERIES: dict[str, Callable] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "metrics_model_cluster"
