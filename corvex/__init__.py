"""corvex: similarity search, corpus indexing and incremental sync as Spark DataFrame plans."""

__version__ = "0.1.0"
