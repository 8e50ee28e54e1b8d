"""Training-data operators: ten stages of a corpus pipeline, as Spark DataFrame functions.

Nothing outside this subpackage (and corpus_pipeline.py, which belongs to it) imports it.
"""
