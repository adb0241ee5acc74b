"""tessera: T-SQL query semantics on Spark DataFrames."""
