"""Resolution-time analytics for municipal service requests, as Spark jobs."""

__version__ = "0.1.0"
