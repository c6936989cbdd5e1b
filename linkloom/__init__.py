"""linkloom: a Spark-first record-linkage and data-processing engine."""
