"""All named queries and their DuckDB SQL."""

from . import control_queries, event_queries, network_queries, structure_queries, survival_queries, text_queries

_MODULES = (event_queries, control_queries, survival_queries, text_queries, network_queries, structure_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
