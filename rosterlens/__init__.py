"""Cohort readiness and risk analytics as Spark DataFrame operators."""
