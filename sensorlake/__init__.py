"""PySpark operators and jobs for multi-sensor field recordings held as tables."""

__version__ = "0.1.0"
