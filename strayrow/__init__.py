"""Find, rank and explain unusual rows of large tables with PySpark."""

__version__ = "0.1.0"
