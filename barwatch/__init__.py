"""Unusual days in price series, on PySpark."""
