"""A SQL and Datalog analytics engine on Spark DataFrames."""
