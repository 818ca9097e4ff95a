"""millrace: a batch analytics engine written directly on PySpark DataFrames."""
