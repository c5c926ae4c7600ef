"""Survival, causal and feature-validation analytics as Spark DataFrame operators."""
