"""tidebar: bar-series analytics as lazy Spark plans."""
