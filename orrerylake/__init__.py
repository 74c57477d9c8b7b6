"""Archive jobs on Spark: labels to metadata, format definitions to schemas, records to typed tables."""
