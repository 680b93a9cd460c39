"""Structural-conformance analytics on PySpark."""
