"""Training-data operators.  Nothing outside this folder (but the guarded hook in
``__spark_entry__`` and ``corpus_pipeline``) imports it."""
