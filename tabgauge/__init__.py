"""Profile, clean, diagnose and forecast tables with Spark DataFrames."""
