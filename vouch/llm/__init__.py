"""Training-data operators. Nothing outside this subpackage imports it, but for __spark_entry__.py and corpus_pipeline.py."""
