"""Wardline: API-security analytics and training-data preparation on Spark."""
