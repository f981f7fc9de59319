"""metaspan: metadata, SQL-lineage and training-data analytics on PySpark."""
