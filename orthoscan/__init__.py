"""Spark-first multidimensional search and data preparation.

Subpackages: ``functions`` (Column builders), ``operators`` (DataFrame to
DataFrame), ``plans`` (multi-step pruned searches and reports), ``sources``
(readers and writers), ``streaming`` (incremental ingest).
"""
