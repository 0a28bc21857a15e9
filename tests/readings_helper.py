"""Tables that tests share."""

from pyspark.sql import functions as F


def readings_frame(spark, rows):
    """Rows (tid, ms, value) as the table of readings, with columns whose names clash with internal ones."""
    df = spark.createDataFrame(rows, "tid int, ms long, value float")
    return df.select("tid", F.timestamp_millis("ms").alias("timestamp"), "value", F.lit("x").alias("b"), F.lit(1).alias("v"), F.lit(2).alias("ts_ms"))
