"""Spark-first analytics for reviewing packages of structured documents."""
