"""Company risk boards and evidence ledgers as Spark DataFrame jobs."""
