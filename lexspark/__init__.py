"""lexspark: ranked retrieval, inverted indexes and set predicates as PySpark columns and DataFrames."""
