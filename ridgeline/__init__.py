"""Ridgeline: structure-aware retrieval, its evaluation and corpus preparation on PySpark."""
