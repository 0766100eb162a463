"""A Spark engine for labelled metric series: storage, ingest, SQL and a PromQL subset compiled to DataFrames."""
