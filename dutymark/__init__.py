"""Tariff-code classification and training-data jobs on PySpark."""
