"""lexalloy: Spark-first analytics over news-like text corpora."""
