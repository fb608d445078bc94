"""Retail membership analytics as Spark jobs.

Sub-packages: ``operators`` (DataFrame -> DataFrame), ``functions`` (column
expressions), ``sources`` (schemas, readers, sinks) and ``plans`` (whole jobs).
"""
