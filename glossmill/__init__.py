"""glossmill: batch retrieval, evidence and training-data analytics on PySpark."""
