"""All queries by name, and DuckDB SQL for those that SQL can express."""

from . import evaluation_queries, report_queries, retrieval_queries, state_queries, text_queries

QUERIES = dict(sorted({**text_queries.QUERIES, **retrieval_queries.QUERIES, **evaluation_queries.QUERIES, **state_queries.QUERIES, **report_queries.QUERIES}.items()))
ORACLES = {**text_queries.ORACLES, **retrieval_queries.ORACLES, **evaluation_queries.ORACLES, **state_queries.ORACLES, **report_queries.ORACLES}
