"""All named queries and their SQL."""

from __future__ import annotations

from recordflow.plans import annotation, dialogue, evaluation, files, mapping, schema, shape

_AREAS = (files, schema, mapping, annotation, shape, dialogue, evaluation)

QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLE = {name: sql for area in _AREAS for name, sql in area.ORACLE.items()}
