"""larkspur: DataFrame transformations for catalogue-style analytics on Spark."""
