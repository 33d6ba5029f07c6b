"""A PySpark engine for querying and maintaining text corpora."""
