"""Batch checking of application forms against label text, as Spark DataFrame plans."""
