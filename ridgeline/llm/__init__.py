"""Training-data operators: filtering, deduplication, encoding and packing of text corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
