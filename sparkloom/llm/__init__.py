"""Training-data operators: scans, filters, deduplication, classifiers and mixing.

Nothing outside this subpackage imports it.
"""
