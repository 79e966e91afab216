"""Web-analytics table operators on Spark DataFrames."""
