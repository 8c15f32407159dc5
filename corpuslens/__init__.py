"""corpuslens: profiling, auditing and preparing large collections with PySpark DataFrames."""
