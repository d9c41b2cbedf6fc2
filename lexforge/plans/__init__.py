"""The registered queries and their DuckDB SQL."""

from lexforge.plans import analysis, connectors, evaluation, preparation, relational, reports, serving, verification

_MODULES = (analysis, connectors, evaluation, preparation, relational, reports, serving, verification)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
