"""Order-risk and profit analytics on Spark: DataFrame in, DataFrame out."""
