"""Model-based time-series analytics on Spark, with data-preparation operators for large corpora of readings."""
