"""Posting intelligence as Spark DataFrame jobs."""
