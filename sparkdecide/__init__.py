"""Decision analytics on Spark tables and streams: DataFrame in, DataFrame out."""
