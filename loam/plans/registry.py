"""Queries by name: each a function of (spark, sf_dir), with the SQL that DuckDB runs for the same rows."""

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Registers the function below under name."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add
