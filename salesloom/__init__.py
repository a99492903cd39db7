"""Retail sales analytics and scoring as Spark DataFrame, SQL and ML jobs."""
