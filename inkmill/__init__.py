"""inkmill: document processing and corpus preparation on PySpark DataFrames."""
