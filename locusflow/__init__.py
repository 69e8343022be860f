"""Population-genetics analytics as PySpark DataFrame operators and batch jobs."""

__version__ = "0.1.0"
