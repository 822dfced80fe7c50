"""plumbline: SQL code and database metadata as data, queried with Spark."""

__version__ = "0.1.0"
