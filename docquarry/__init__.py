"""A document query engine on Spark: schemaless JSON collections and Parquet tables under one query language."""
