"""Spark-first table operators for mass-spectrometry style analytics."""
