"""Spark-native data operators for ETL estates: extraction, lineage, audit, observability, evaluation."""
