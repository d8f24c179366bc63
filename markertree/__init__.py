"""markertree: interpretable marker trees over large cell-by-feature tables, on PySpark."""

__version__ = "0.1.0"
