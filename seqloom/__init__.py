"""Seqloom: sequence search and surveillance analytics as Spark DataFrame plans."""
