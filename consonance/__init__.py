"""consonance: agreement and factuality analytics for groups of long-form texts, on Spark."""

__version__ = "0.1.0"
