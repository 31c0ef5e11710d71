"""Named queries over the given tables, each with SQL that checks it."""

from dateline.plans import article_queries, page_queries, place_queries, time_queries, vector_queries

_MODULES = (page_queries, article_queries, time_queries, place_queries, vector_queries)


def all_queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
