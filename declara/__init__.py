"""Label compliance analytics on Spark: DataFrame in, DataFrame out."""
