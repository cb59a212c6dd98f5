"""Progress-aware knowledge-graph analytics expressed as Spark DataFrame jobs."""
