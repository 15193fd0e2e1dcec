"""lakeleaf: a document knowledge engine whose every query is a Spark plan."""

__version__ = "0.1.0"
