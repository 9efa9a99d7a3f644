"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from reviewlens.llm import queries as q
from reviewlens.llm import sql

QUERIES = {f.__name__: f for f in q.ALL}
ORACLE_SQL = dict(sql.ORACLE_SQL)
