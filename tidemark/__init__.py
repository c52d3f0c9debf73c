"""tidemark — a Spark-native engine for upload → create → publish content analytics.

Layout:
  sources/    table readers, CSV export readers, the domain adapter over the driver tables
  functions/  column expressions (durations, month labels, safe ratios, text booleans)
  operators/  filters, joins, aggregates, windows, ordering, reshaping, quality checks, search
  plans/      composite jobs: marts, KPI rows, star schema, ingestion, the SQL corpus
  streaming/  Structured Streaming variants of ingestion and time rollups
"""

from tidemark.session import get_spark, scratch_dir  # noqa: F401
