"""termforge: a PySpark text-retrieval and learning-to-rank feature engine."""

__version__ = "0.1.0"
