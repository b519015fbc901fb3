"""All queries of the library and their SQL."""

from __future__ import annotations

from polisgraph.plans import bundleq, checksq, cleanq, dossierq, entityq, extraq, factq, graphq, identityq, layoutq, minutesq, returnq, tabular, views, workbookq

_MODULES = (tabular, graphq, views, cleanq, extraq, entityq, bundleq, checksq, layoutq, identityq, minutesq, dossierq, returnq, workbookq, factq)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
