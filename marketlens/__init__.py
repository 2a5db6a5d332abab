"""PySpark operators for short-horizon binary ("Up or Down") markets."""

__version__ = "0.1.0"
