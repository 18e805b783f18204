"""Spark-native genomic interval, variant and sequence analytics.

Sub-packages
------------
``sources``    readers and writers for genomics text formats and shards
``functions``  column expressions (sequence, binning, statistics)
``operators``  interval algebra, joins, aggregations, sampling, metrics
``plans``      multi-step recipes and the demo views over the test tables
``streaming``  Structured Streaming forms of operators with small state
``llm``        training-data operators; nothing else imports it
"""
