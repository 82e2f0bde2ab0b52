"""Subword tokenizers: training as Spark jobs, encoding as map-side Arrow functions."""
