"""The registry of queries and of their SQL counterparts.

Modules of this package list rows (name, function, SQL); SQL is None where the
operator can't be put in it.
"""

from __future__ import annotations

from . import auditing, evaluation, evidence, language, linking, projecting, retrieval, streams, submissions

_MODULES = (retrieval, evidence, linking, auditing, language, evaluation, streams, submissions, projecting)


def _rows() -> list:
    return [row for m in _MODULES for row in m.QUERIES]


def queries() -> dict:
    return {name: function for name, function, _ in _rows()}


def oracle_sql() -> dict:
    return {name: sql for name, _, sql in _rows() if sql}
