"""The query registry (``queries``) and the matching DuckDB oracle SQL (``oracle``)."""
