"""Membership analytics as plain PySpark DataFrame jobs."""
