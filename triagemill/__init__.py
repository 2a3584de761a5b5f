"""Alert-triage analytics on Spark DataFrames and Structured Streaming."""
