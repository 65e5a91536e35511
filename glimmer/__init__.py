"""Activation analytics and corpus preparation on Spark."""
