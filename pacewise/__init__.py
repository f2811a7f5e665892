"""pacewise — advertising-operations analytics as plain Spark DataFrame jobs.

Layers:
  sources/    test-table bindings, CSV readers, sinks, manifests
  functions/  column helpers (portable rounding, alias maps, rule registry)
  operators/  dedup, silver cleaning, data quality, tickets, conversions
  plans/      composed queries: ad-hoc analytics, gold tables, health, KPIs
  streaming/  incremental file ingestion and streaming dedup
"""

from pacewise.config import AS_OF, AS_OF_DATE

__all__ = ["AS_OF", "AS_OF_DATE"]
