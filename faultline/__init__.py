"""Faultline: test-run and failure analytics as PySpark DataFrame operators."""
