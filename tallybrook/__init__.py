"""Payment analytics on Spark: parse, validate, score, count and summarise payment events."""
