"""Document analytics on Spark: filters, pipelines, versioned tables and search as DataFrame plans."""
