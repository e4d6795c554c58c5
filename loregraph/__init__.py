"""Loregraph: multi-tenant temporal knowledge graphs as Spark DataFrames."""

__version__ = "0.1.0"
