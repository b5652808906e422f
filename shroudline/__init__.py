"""Sensitive-data detection, policy and audit analytics as Spark jobs."""
