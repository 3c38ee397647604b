"""opsward — operational-data analytics as Spark DataFrame jobs.

Feeds land in a keyed warehouse (batch or incremental), are kept current with
upserts and retention, and are queried for freshness, integrity, logs, corpus
references and catalog worklists.  Every operator is a pure
``DataFrame -> DataFrame`` function; IO lives in ``sources`` and ``sinks``.
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
