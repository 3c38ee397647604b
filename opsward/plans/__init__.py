"""Query plans bound to the driver tables; each has a DuckDB oracle SQL twin."""
