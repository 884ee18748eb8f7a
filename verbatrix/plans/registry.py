"""Queries over the driver tables and the SQL that defines their results."""

from __future__ import annotations

from verbatrix.plans import code, corpus, evaluation


def queries() -> dict:
    return corpus.queries() | evaluation.queries() | code.queries()


def oracle_sql() -> dict[str, str]:
    return corpus.oracle_sql() | evaluation.oracle_sql() | code.oracle_sql()
