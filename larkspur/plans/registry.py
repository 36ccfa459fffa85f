"""All queries of the library and their DuckDB equivalents."""

from larkspur.plans import engagement, files, ledger, ranking, recsys, retrieval, text

MODULES = (retrieval, engagement, ranking, text, recsys, ledger, files)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
