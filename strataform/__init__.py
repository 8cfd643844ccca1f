"""strataform: schema-driven analytics on Spark DataFrames."""
