"""lexforge: a Spark-first engine for text corpora and claim verification."""
