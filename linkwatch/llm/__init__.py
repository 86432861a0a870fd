"""Training-data operators: the corpus operators and their queries.

Nothing outside this subpackage imports it; ``catalog`` holds the registered
queries and their DuckDB SQL.
"""
