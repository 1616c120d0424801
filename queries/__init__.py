"""The queries registered in ``__spark_entry__`` and their SQL counterparts."""
