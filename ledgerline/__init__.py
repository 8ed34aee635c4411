"""Record-linkage and corpus analytics on PySpark DataFrames."""
