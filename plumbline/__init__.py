"""plumbline: a Spark-first multi-model query engine."""
