"""Spark-first analytics for customer-service records, documents and conversations."""
