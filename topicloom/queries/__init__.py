"""Named queries over the given tables, each with its DuckDB counterpart where SQL can say it."""
