"""Spark-first statistical disclosure control: risk, recoding, protection, utility."""
