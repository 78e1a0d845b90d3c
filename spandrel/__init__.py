"""spandrel: positioned page text and parsed tables as validated, queryable Spark relations."""

__version__ = "0.1.0"
