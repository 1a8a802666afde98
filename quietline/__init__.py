"""Router-telemetry outage analytics on Spark DataFrames, SQL, pyspark.ml and Structured Streaming."""
