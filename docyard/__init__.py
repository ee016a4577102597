"""docyard: corpus-scale document preparation for retrieval, on Spark.

Every step is a ``DataFrame -> DataFrame`` function that keeps the metadata
columns it does not touch, so steps compose with ``df.transform(...)`` and run
the same way over one file or a whole corpus, in batch or inside a streaming
``foreachBatch``.
"""

__version__ = "0.1.0"
