"""DuckDB statements the registered queries are compared with."""
