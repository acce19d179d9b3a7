"""quillon: corpus indexing and ranked retrieval on PySpark DataFrames."""
